"""Projects on disk: reading, detection, validation, writing and reading back."""

import gzip

import pytest
from pyspark.sql import functions as F

from leafwork.catalog import corpora
from leafwork.operators import lookup, validate
from leafwork.plans.open_projects import Opened, open_projects
from leafwork.session import cut_lineage
from leafwork.sinks import documents, named_files, topics as topic_sinks
from leafwork.sources import files, json_config, xml_config

TREE = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE instance-profile
        SYSTEM "https://example.org/profile.dtd">

<instance-profile id="007" name="A &amp; B" start-page="parent.md">
    <toc-element topic="parent.md">
        <toc-element topic="child1.md"/>
        <toc-element topic="child2.md"/>
    </toc-element>
</instance-profile>"""
MODULE = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE ihp SYSTEM "https://example.org/ihp.dtd">
<ihp version="2.0">
    <topics dir="pages" web-path="topics"/>
    <instance src="valid.tree" version="1.0"/>
    <instance src=""/>
    <instance/>
    <instance src="absent.tree"/>
    <instance src="other.tree"/>
</ihp>"""
GOOD = '{"topics":{"dir":"topics"},"instances":[{"id":"as","name":"S","toc-elements":[{"topic":"a.md","children":[{"topic":"b.md","title":"own"}]},{"topic":"none.md"}]}]}'


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")


@pytest.fixture(scope="module")
def opened(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    put(root / "j/docs.config.json", GOOD)
    put(root / "j/topics/a.md", "\n# Head A\nx")
    put(root / "j/topics/b.md", "# Head B")
    put(root / "j/topics/c d+e%.md", "# Odd name")
    put(root / "x/module.cfg", MODULE)
    put(root / "x/valid.tree", TREE)
    put(root / "x/other.tree", "<invalid/>")
    put(root / "x/pages/parent.md", "# Parent")
    put(root / "x/pages/child2.md", "no title")
    # Cannot be read, so the XML configuration is used.
    put(root / "both/docs.config.json", GOOD[:-3])
    put(root / "both/module.cfg", MODULE)
    put(root / "both/valid.tree", TREE)
    # Can be read but is invalid, so the project is refused.
    put(root / "bad/docs.config.json", '{"colour":1,"topics":[],"instances":[{"toc-elements":[{"topic":"a.md","sort-children":"up","children":5}]}]}')
    put(root / "bad/module.cfg", MODULE)
    j = files.read_json_configs(spark, f"{root}/*/*.config.json")
    x = files.read_xml_configs(spark, f"{root}/*/*.cfg")
    trees = files.read_tree_files(spark, f"{root}/*/*.tree")
    folders = json_config.projects(j).unionByName(xml_config.projects(x))
    topics = files.read_topics(spark, f"{root}/*/*/*.md", folders)
    result = open_projects(j.select("project_id", "content"), x.select("project_id", "content"), trees, topics)
    return root, Opened(*map(cut_lineage, result)), topics


def test_titles_need_one_scan_and_move_no_content(spark, opened):
    root, result, topics = opened
    folders = result.projects
    titles = files.read_titles(spark, f"{root}/*/*/*.md", folders)
    want = {(r.project_id, r.file, r.file_title) for r in lookup.file_titles(topics).collect()}
    got = {(r.project_id, r.file, r.file_title) for r in lookup.file_titles(titles).collect()}
    # Refused projects have no folder of their own in this table.
    assert {t for t in want if not t[0].endswith("bad")} == {t for t in got if not t[0].endswith("bad")}
    plan = titles._jdf.queryExecution().optimizedPlan().toString()
    join = plan[: plan.index("Join")]
    assert plan.count("Relation") - plan.count("LocalRelation") <= 2 and "value" not in join and "content" not in join
    with_titles = open_projects(
        files.read_json_configs(spark, f"{root}/*/*.config.json"), files.read_xml_configs(spark, f"{root}/*/*.cfg"),
        files.read_tree_files(spark, f"{root}/*/*.tree"), titles,
    )
    assert sorted(map(repr, with_titles.nodes.select("topic", "title").collect())) == sorted(map(repr, result.nodes.select("topic", "title").collect()))


def test_only_files_that_a_tree_names_are_opened(spark, tmp_path):
    odd = ["a.md", "c d+e%.md", "[x]{y}?.md", "sub/deep,er*.md"]
    for name in [*odd, "other.md", "sub/other.md"]:
        put(tmp_path / "p/topics" / name, f"# Title of {name}")
    folders = spark.createDataFrame([(f"{tmp_path}/p", None)], "project_id string, topics_dir string")
    named = spark.createDataFrame([(f"{tmp_path}/p", n) for n in [*odd, "missing.md"]], "project_id string, file string")
    glob = [f"{tmp_path}/p/topics/*.md", f"{tmp_path}/p/topics/sub/*.md"]
    for pattern in glob:
        titles = files.read_titles(spark, pattern, folders, named)
        want = {n for n in odd if ("/" in n) == ("sub" in pattern.rsplit("topics")[1])}
        assert {(r.file, r.title) for r in titles.collect()} == {(n, f"Title of {n}") for n in want}
    listed = files.list_files(spark, glob[0]).where("path not like '%other%'")
    assert len(files.read_listed(spark, listed).inputFiles()) == 3
    assert files.read_listed(spark, listed, batch=2).count() == 3
    assert files.read_listed(spark, listed.limit(0)).count() == 0


def test_detection(opened):
    root, result, _ = opened
    got = {r.project_id.rsplit("/", 1)[1]: (r.dialect, r.config_code) for r in result.projects.collect()}
    assert got == {"j": ("J", 2), "x": ("X", 1), "both": ("X", 1), "bad": (None, 0)}


def test_nodes_and_titles(opened):
    _, result, topics = opened
    rows = {(r.project_id.rsplit("/", 1)[1], tuple(r.node_path)): (r.topic, r.title) for r in result.nodes.collect()}
    assert rows == {
        ("j", (0,)): ("a.md", "Head A"),
        ("j", (0, 0)): ("b.md", "own"),
        ("j", (1,)): ("none.md", "<none.md>"),
        ("x", (0,)): ("parent.md", "Parent"),
        ("x", (0, 0)): ("child1.md", "<child1.md>"),
        ("x", (0, 1)): ("child2.md", "<child2.md>"),
        ("both", (0,)): ("parent.md", "<parent.md>"),
        ("both", (0, 0)): ("child1.md", "<child1.md>"),
        ("both", (0, 1)): ("child2.md", "<child2.md>"),
    }
    assert {r.file for r in topics.collect()} == {"a.md", "b.md", "c d+e%.md", "parent.md", "child2.md"}


def test_identifiers_keep_their_zeros(opened):
    _, result, _ = opened
    got = {(r.instance_id, r.name) for r in result.instances.where("tree_path is not null").collect()}
    assert got == {("007", "A & B")}


def test_all_violations_are_reported(opened):
    _, result, _ = opened
    got = {tuple(r)[1:4] for r in result.violations.collect()}
    assert got == {
        ("", "additionalProperties", "colour"),
        ("/topics", "type", "object"),
        ("/instances/0/toc-elements/0/sort-children", "enum", "up"),
        ("/instances/0/toc-elements/0/children", "type", "array"),
        ("", "parse", "unreadable"),
    }


def test_violation_rules(spark):
    cases = {
        "null": {("", "type", "object")},
        "[]": {("", "type", "object")},
        "{}": set(),
        '{"a":': {("", "parse", "unreadable")},
        '{"instances":{}}': {("/instances", "type", "array")},
        '{"instances":[1]}': {("/instances/0", "type", "object")},
        '{"images":{"dir":1,"height":"x"}}': {("/images/dir", "type", "string"), ("/images", "additionalProperties", "height")},
        # A top-level title is replaced where there is a topic; elsewhere it is checked.
        '{"instances":[{"toc-elements":[{"topic":"a","title":1},{"title":1,"children":[{"topic":"a","title":2}]}]}]}': {
            ("/instances/0/toc-elements/1/title", "type", "string"),
            ("/instances/0/toc-elements/1/children/0/title", "type", "string"),
        },
        '{"instances":[{"toc-elements":[{"sortChildren":7}]}]}': {
            ("/instances/0/toc-elements/0/sortChildren", "type", "string"),
            ("/instances/0/toc-elements/0/sortChildren", "enum", "7"),
        },
    }
    df = spark.createDataFrame(list(enumerate(cases)), "project_id int, content string")
    got = {i: set() for i in range(len(cases))}
    for r in validate.violations(df).collect():
        got[r.project_id].add((r.instance_path, r.keyword, r.detail))
    assert list(got.values()) == list(cases.values())


def test_readability(spark):
    cases = {
        GOOD: True, "{": False, "{}": True, '{"instances":null}': True, '{"instances":5}': False,
        '{"instances":[{}]}': False, '{"instances":[{"toc-elements":[{"topic":5}]}]}': False,
        '{"instances":[{"toc-elements":[{"topic":""},{}]}]}': True, '{"instances":[{"toc-elements":[null]}]}': False,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "project_id int, content string")
    got = {r.project_id: r.readable for r in json_config.readability(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


@pytest.mark.parametrize("depth", [9, 200])
def test_deep_trees_load_completely_beside_small_ones(spark, depth):
    raw = '{"topic":"t","title":"leaf"}'
    for _ in range(depth - 1):
        raw = f'{{"topic":"t","children":[{raw},{{"topic":"s"}}]}}'
    whole = f'{{"instances":[{{"id":"i","name":"n","start-page":"t","toc-elements":[{raw}]}}]}}'
    bad = whole.replace('"title":"leaf"', '"title":"leaf","odd":1')
    small = '{"instances":[{"id":"i","toc-elements":[{"topic":"x"}]}]}'
    df = spark.createDataFrame([("p", whole), ("q", small), ("b", bad)], "project_id string, content string")
    rows = json_config.nodes(df).collect()
    assert {("p", depth, "leaf"), ("q", 1, None), ("b", depth, "leaf")} <= {(r.project_id, len(r.node_path), r.title) for r in rows}
    assert sum(r.project_id == "p" for r in rows) == 2 * depth - 1
    found = [(r.project_id, r.keyword, r.instance_path.count("/")) for r in validate.violations(df).collect()]
    assert found == [("b", "additionalProperties", 2 * depth + 2)]
    xml = "<instance-profile id='i'>" + "<toc-element topic='t&amp;&lt;\"'>" * depth + "</toc-element>" * depth + "<toc-element topic='u'/></instance-profile>"
    trees = spark.createDataFrame([("p/f", xml), ("p/g", "<instance-profile id='k'><toc-element topic='x'/></instance-profile>")], "path string, content string")
    rows = xml_config.nodes(trees).collect()
    assert sum(r.topic == 't&<"' for r in rows) == depth and len(rows) == depth + 2

    modules = spark.createDataFrame([("m", '<ihp version="2.0"><instance src="f"/><instance src="g"/></ihp>')], "project_id string, content string")
    at_m = trees.withColumn("path", F.regexp_replace("path", "^p", "m"))
    topics = spark.createDataFrame([("p", "t", "# T")], "project_id string, file string, content string")
    opened = open_projects(df, modules, at_m, topics)
    counts = {r.project_id: r["count"] for r in opened.nodes.groupBy("project_id").count().collect()}
    assert counts == {"p": 2 * depth - 1, "q": 1, "m": depth + 2}


def test_write_and_read_back(spark, opened):
    _, result, _ = opened
    instances, nodes = result.instances, result.nodes.withColumn("topic", F.concat("topic", F.lit(" <&'\">")))
    pieces = documents.tree_pieces(instances, nodes)
    text = documents.assemble(pieces, ["project_id", "instance_id"])
    back = xml_config.nodes(text.select(F.concat_ws("/", "project_id", "instance_id").alias("path"), "content"))
    want = nodes.select(F.concat_ws("/", "project_id", "instance_id").alias("path"), "instance_id", "node_path", "topic")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, want.collect()))

    configs = documents.assemble(documents.config_pieces(result.projects, instances, nodes), ["project_id"])
    again = json_config.nodes(configs).drop("dialect")
    want = nodes.select(*again.columns)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, want.collect()))
    assert validate.violations(configs).count() == 0


def test_large_documents_come_in_ordered_blocks(spark, opened):
    _, result, _ = opened
    pieces = documents.tree_pieces(result.instances, result.nodes)
    keys = ["project_id", "instance_id"]
    whole = {(r.project_id, r.instance_id): r.content for r in documents.assemble(pieces, keys).collect()}
    parts = documents.assemble(pieces, keys, block=3).orderBy(*keys, "block").collect()
    assert len(parts) > len(whole)
    for key, text in whole.items():
        assert "".join(r.content for r in parts if (r.project_id, r.instance_id) == key) == text


def test_module_text(spark):
    projects = spark.createDataFrame([("p", "docs", None, None, None)], "project_id string, topics_dir string, images_dir string, images_version string, images_web_path string")
    registry = spark.createDataFrame([("p", 0, "a&b.tree", None)], "project_id string, ordinal int, src string, version string")
    text = documents.assemble(documents.module_pieces(projects, registry), ["project_id"]).first().content
    assert text == '<?xml version="1.0" encoding="UTF-8"?>\n<ihp version="2.0">\n    <topics dir="docs"/>\n    <instance src="a&amp;b.tree"/>\n</ihp>\n'


def test_unreadable_modules_are_refused_with_an_error(spark):
    cases = {
        MODULE: True, "<ihp/>": True, " <!-- c --><ihp><![CDATA[x]]></ihp>": True, "<ihp>" + "<a>" * 400 + "</a>" * 400 + "</ihp>": True,
        "<ihp": False, "no xml at all": False, "": False, None: False, "<ihp><topics></ihp>": False, "<ihp>&undefined;</ihp>": False,
        "<ihp a=1/>": False, "<ihp a='1' a='2'/>": False, '<?xml version="1.0"?>': False, "<ihp>a & b</ihp>": False,
    }
    modules = spark.createDataFrame([(f"/m{i}", t) for i, t in enumerate(cases)], "project_id string, content string")
    got = {r.project_id: r.readable for r in xml_config.readability(modules).collect()}
    assert got == {f"/m{i}": good for i, good in enumerate(cases.values())}
    none = spark.createDataFrame([], "project_id string, content string")
    trees = spark.createDataFrame([("/m0/valid.tree", TREE)], "path string, content string")
    topics = spark.createDataFrame([], "project_id string, file string, content string")
    result = open_projects(none, modules, trees, topics)
    refused = {p for p, good in got.items() if not good}
    assert {(r.project_id, r.dialect, r.config_code) for r in result.projects.collect()} == {(p, "X" if good else None, int(good)) for p, good in got.items()}
    assert {tuple(r) for r in result.violations.collect()} == {(p, "", "parse", "unreadable", "X") for p in refused}
    assert {r.project_id for r in result.nodes.collect()} == {"/m0"}


def test_module_elements_are_balanced(spark):
    import random

    rng = random.Random(3)

    def element(depth):
        name, inner = rng.choice("ab"), "".join(part(depth - 1) for _ in range(rng.randint(0, 3))) if depth else ""
        space = rng.choice(["", " x='>'", ' y="/>"', ' z="</a>"'])
        return f"<{name}{space}>{inner}</{name}>" if inner or rng.random() < 0.5 else f"<{name}{space}/>"

    def part(depth):
        return rng.choice([element, element, lambda _: "<!-- <a> -->", lambda _: "<?do </b>?>", lambda _: "<![CDATA[<a>]]>", lambda _: "t&lt;"])(depth)

    rows, want = [], {}
    for k in range(60):
        parts = [element(rng.randint(0, 5)) for _ in range(rng.randint(0, 8))] if k else ["<a>" * 900 + "</a>" * 900, *["<instance src='x'/>"] * 5000]
        rows.append((f"p{k}", "<ihp>\n" + "\n  ".join(parts) + "\n</ihp>"))
        want[f"p{k}"] = parts
    got = {p: [] for p in want}
    configs = spark.createDataFrame(rows, "project_id string, content string")
    for r in xml_config.elements(configs).where("ordinal >= 0").orderBy("project_id", "ordinal").collect():
        got[r.project_id].append(r.text)
        assert r.text.startswith(f"<{r.tag}")
    assert got == want
    assert xml_config.written_registry(configs).where("project_id = 'p0'").count() == 5000


def test_topic_files(spark):
    topics = spark.createDataFrame([("p", "a.md", "A"), ("p", "b.md", "B")], "project_id string, file string, content string")
    asked = spark.createDataFrame([("p", "a.md", "x", 1), ("p", "n.md", "New", 2), ("p", "n.md", "Newer", 3)], "project_id string, file string, title string, seq long")
    assert [tuple(r) for r in topic_sinks.new_stubs(asked, topics).collect()] == [("p", "n.md", "# New\n\nContent goes here...")]
    assert {r.seq: r.created for r in topic_sinks.create_results(asked, topics).collect()} == {1: False, 2: True, 3: False}
    renames = spark.createDataFrame([("p", "a.md", "b.md", 1), ("p", "b.md", "c.md", 2)], "project_id string, file string, new_file string, seq long")
    assert {(r.file, r.content) for r in topic_sinks.rename_files(topics, renames).collect()} == {("a.md", "A"), ("c.md", "B")}


def test_files_get_names_of_their_own(spark, tmp_path):
    rows = [("p/a b+%.md", "# A\nü"), ("p/empty.md", ""), ("q/none.md", None), ("p/twice.md", "one"), ("p/twice.md", "two")]
    target = f"file:{tmp_path}/cor pus"
    named_files.write_files(spark.createDataFrame(rows, "path string, content string").repartition(3), target)
    found = {str(f.relative_to(tmp_path / "cor pus")): f.read_bytes().decode() for f in (tmp_path / "cor pus").rglob("*") if f.is_file()}
    assert sorted(found.pop("p/twice.md").split("\n")) == ["", "one", "two"]
    assert found == {"p/a b+%.md": "# A\nü\n", "p/empty.md": "\n", "q/none.md": "\n"}
    named_files.write_files(spark.createDataFrame([], "path string, content string"), target)
    assert not [f for f in (tmp_path / "cor pus").iterdir() if f.name.startswith(".")]


def test_a_corpus_has_one_plain_file_for_each_topic(spark, tmp_path, monkeypatch):
    rows = [(i, f"Text {i}") for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpora, "scratch_folder", lambda _: f"file:{tmp_path}/scratch")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    assert corpora.files_roundtrip(spark, str(tmp_path)).count() == 75
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    paths = ["/".join(f.parts[-3:]) for f in (tmp_path / "scratch").rglob("*.md")]
    assert sorted(paths) == sorted(f"project=p{i // 20}/docs=md/doc-{i}.md" for i, _ in rows)
    # No checksum, folder or marker of its own for a file.
    everything = [f for f in (tmp_path / "scratch").rglob("*") if f.is_file()]
    assert len(everything) == 100 + 3 + 2 * 2


def test_topics_are_opened_once(spark, tmp_path):
    put(tmp_path / "p/topics/a.md", "# A")
    folders = spark.createDataFrame([(f"{tmp_path}/p", None)], "project_id string, topics_dir string")
    topics = files.read_topics(spark, f"{tmp_path}/p/topics/*.md", folders)
    assert [(r.file, r.content) for r in topics.collect()] == [("a.md", "# A")]
    plan = topics._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "text" in line.split("Relation")[1] for line in plan.splitlines()) == 1


def test_a_large_corpus_is_listed_in_parts(spark, tmp_path, monkeypatch):
    rows = [(i, f"Text {i}") for i in range(240)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpora, "_AT_ONCE", 20)
    docs = spark.createDataFrame([(f"p{i // 20}",) for i, _ in rows], "project string")
    assert corpora._globs(docs, "f") == sorted([f"f/project=*p{i}/docs=md" for i in range(10)] + [f"f/project=*{i}/docs=md" for i in (10, 11)])
    monkeypatch.setattr(corpora, "_AT_ONCE", 200)
    found = corpora.pruned_titles(spark, str(tmp_path)).collect()
    want = {(f"p{i // 20}", f"doc-{i}.md") for i, _ in rows if i % 4 != 3 and i // 20 % 2 == 0}
    assert len(found) == len(want) and {(r.project_id, r.file) for r in found} == want


def test_many_files_are_listed_and_opened_in_tasks(spark, tmp_path, monkeypatch):
    for n, name in enumerate(["p/t/a b+%25.md", "p/t/_no.md", "p/t/.no.md", "p/t/_yes=1.md", "q/t/ü.md", "q/t/sub/deep.md", ".r/t/x.md", "_s/t/y.txt", "q/u/z.md", "a.md"]):
        put(tmp_path / name, f"# {n}\n")
    put(tmp_path / "p/t/empty.md", "")
    (tmp_path / "q/t/latin.md").write_bytes(b"# \xe9\r\n")
    (tmp_path / "q/t/gone.md").symlink_to(tmp_path / "nowhere")
    told = lambda df: sorted(map(tuple, df.select("path", F.col("content").cast("binary")).collect()))
    assert not any(files.in_tasks(spark, f"{tmp_path}/{glob}") for glob in ("p/t", "*/../t", "[pq]/*", "{p,q}/*", "*/?.md"))
    assert not files.in_tasks(spark, "viewfs://store/*/t")
    monkeypatch.setattr(files, "_FEW", 0)
    for glob in ("*/t", "*/t/*.md", "*/*/*", "*", "q/*/z.md"):
        scanned, got = files._scanned(spark, f"{tmp_path}/{glob}"), files.read_files(spark, f"file:{tmp_path}/{glob}")
        assert told(got) == told(scanned) and not got.inputFiles()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_files(spark, f"{tmp_path}/*/absent")
    # A topic of two projects is read for both; a packed one is left to Spark.
    folders = spark.createDataFrame([(f"{tmp_path}/q", "t"), (f"{tmp_path}", "q/t"), (f"{tmp_path}/p", "t")], "project_id string, topics_dir string")
    topics = files.read_topics(spark, f"{tmp_path}/*/t/*.md", folders)
    assert not topics.inputFiles()
    assert sorted((r.file, r.content) for r in topics.collect() if "ü" in r.file) == [("ü.md", "# 4\n"), ("ü.md", "# 4\n")]
    (tmp_path / "p/t/z.md.gz").write_bytes(gzip.compress(b"# packed"))
    assert ("# packed",) in [(r.content,) for r in files.read_files(spark, f"{tmp_path}/p/t/*").collect()]
    assert sum(r.content == "# packed" for r in files.read_topics(spark, f"{tmp_path}/*/t/*", folders).collect()) == 1


def test_titles_of_many_named_files_are_read_in_tasks(spark, tmp_path, monkeypatch):
    for name in ("a.md", "sub/b.md", "c.md"):
        put(tmp_path / "p/t" / name, f"# {name}")
    folders = spark.createDataFrame([(f"{tmp_path}/p", "t")], "project_id string, topics_dir string")
    named = spark.createDataFrame([(f"{tmp_path}/p", name) for name in ("a.md", "sub/b.md", "none.md")], "project_id string, file string")
    monkeypatch.setattr(files, "_FEW", 0)
    titles = [files.read_titles(spark, f"{tmp_path}/p/*{end}", folders, named) for end in ("/*.md", "/sub/*.md")]
    assert [[(r.file, r.title) for r in found.collect()] for found in titles] == [[("a.md", "a.md")], [("sub/b.md", "sub/b.md")]]
    assert not any(found.inputFiles() for found in titles)
