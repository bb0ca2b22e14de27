"""Configurations in blocks, and those that make no variant: very deep ones, and those with repeated keys."""

import json
import random

import pytest

from leafwork.operators import validate
from leafwork.plans.open_projects import open_projects
from leafwork.session import cut_lineage
from leafwork.sinks import documents
from leafwork.sources import json_blocks, json_config


def tree(depth, leaf='{"topic":"t"}'):
    return '{"topic":"t","children":[' * (depth - 1) + leaf + "]}" * (depth - 1)


def config(toc):
    return f'{{"instances":[{{"id":"i","toc-elements":[{toc}]}}]}}'


@pytest.mark.parametrize("depth", [600, 2000])
def test_a_deep_json_tree_is_opened(spark, depth):
    texts = {
        "good": config(tree(depth)), "bad": config(tree(depth, '{"topic":"t","odd":1,"sortChildren":7}')),
        "cut": config(tree(depth))[:-1], "number": config(tree(depth).replace('"t"', "5", 1)), "small": config(tree(1)),
    }
    configs = spark.createDataFrame(list(texts.items()), "project_id string, content string")
    modules = spark.createDataFrame([], "project_id string, content string")
    trees = spark.createDataFrame([], "path string, content string")
    topics = spark.createDataFrame([("good", "t", "# T")], "project_id string, file string, content string")
    assert {r.project_id: r.readable for r in json_config.readability(configs).collect()} == {
        "good": True, "bad": True, "cut": False, "number": False, "small": True,
    }
    opened = open_projects(configs, modules, trees, topics)
    assert {r.project_id: r.config_code for r in opened.projects.collect()} == {"good": 2, "bad": 0, "cut": 0, "number": 0, "small": 2}
    assert {r.project_id: r["count"] for r in opened.nodes.groupBy("project_id").count().collect()} == {"good": depth, "small": 1}
    at = "/instances/0/toc-elements/0" + "/children/0" * (depth - 1)
    assert {tuple(r)[:4] for r in opened.violations.collect()} == {
        ("bad", at, "additionalProperties", "odd"),
        ("bad", f"{at}/sortChildren", "type", "string"),
        ("bad", f"{at}/sortChildren", "enum", "7"),
        ("cut", "", "parse", "unreadable"),
        ("number", "/instances/0/toc-elements/0/topic", "type", "string"),
    }
    assert {r.project_id for r in validate.accepted(configs, opened.violations).collect()} == {"good", "small"}


def test_of_repeated_keys_the_last_one_counts(spark):
    texts = ['{"topics":{"x":1},"topics":{"dir":"a"},"instances":5,"instances":[]}', '{"topics":{"dir":"a"},"topics":5}', '[{"a":1,"a":2}]']
    df = spark.createDataFrame(list(enumerate(texts)), "project_id int, content string")
    assert {r.project_id: r.readable for r in json_config.readability(df).collect()} == {0: True, 1: True, 2: True}
    assert {tuple(r)[:4] for r in validate.violations(df).collect()} == {(1, "/topics", "type", "object"), (2, "", "type", "object")}


def test_values_by_tokens_equal_the_variant_rules(spark):
    rng = random.Random(3)
    values = ["x", "", 5, 0, 1.5, True, False, None, "none", "up", [], {}, {"a": 1}, "{}", "[1]"]

    def some(keys, share):
        return {k: rng.choice(values) for k in rng.sample(keys, len(keys)) if rng.random() < share}

    def toc(depth):
        node = some(["id", "topic", "title", "sort-children", "sortChildren", "children", "odd"], 0.25)
        if depth and rng.random() < 0.8:
            node["children"] = [toc(depth - 1) for _ in range(rng.randint(0, 2))]
        return node if rng.random() < 0.95 else rng.choice(values)

    def whole():
        instances = [some(["id", "name", "odd"], 0.3) | {"toc-elements": [toc(11) for _ in range(rng.randint(0, 3))]} for _ in range(rng.randint(0, 3))]
        top = some(["schema", "title", "images", "odd"], 0.3) | {"topics": some(["dir", "odd"], 0.4), "instances": [*instances, *rng.sample(values, rng.random() < 0.2)]}
        return top | ({"instances": rng.choice(values)} if rng.random() < 0.1 else {})

    texts = [json.dumps(whole(), indent=rng.choice([None, 1])) for _ in range(400)] + [json.dumps(v) for v in values] + ["", "{", '{"a":}', '{"a":1,}', "[1,]", "[01]", '"a', "nul", "]", '{"a":1]', "[1}", "1 2", "{} x", "[] []", "1,2", "null null", '{"a" 1}', "{1:2}", "[,]", "{,}", '"\\x"', '"a\nb"', "[1 2]", None]
    df = spark.createDataFrame(list(enumerate(texts)), "project_id int, content string")
    rows = lambda found: sorted(repr(tuple(r)[:4]) for r in found.collect())
    blocks = json_config.as_blocks(df)
    assert rows(validate.violations(df)) == rows(json_blocks.violations(blocks))
    assert rows(json_config.readability(df)) == rows(json_blocks.readability(blocks))


def test_nodes_by_tokens_equal_those_of_the_reader(spark):
    rng = random.Random(4)

    def toc(depth):
        node = {k: rng.choice(["x", "a b", 'q"\\u00e9\n', ""]) for k in ["topic", "title", *json_config.MORE] if rng.random() < 0.4}
        return node | ({"children": [toc(depth - 1) for _ in range(rng.randint(0, 2))]} if depth else {})

    texts = [json.dumps({"instances": [{"toc-elements": [toc(12) for _ in range(3)], "id": f"i{k}"} for k in range(2)]}) for _ in range(20)]
    texts.append('{"instances":[{"id":"a","toc-elements":[{"topic":"x"}]}],"instances":[{"toc-elements":[{"topic":"y","topic":"z","children":[{}],"children":[]}]}]}')
    df = spark.createDataFrame(list(enumerate(texts)), "project_id int, content string")
    rows = lambda df: sorted(repr((r.project_id, r.instance_id, r.node_path, r.topic, r.title, r.more)) for r in df.collect())
    assert rows(json_blocks.nodes(json_config.as_blocks(df), json_config.MORE)) == rows(json_config.nodes(df))


def test_a_configuration_in_blocks_is_read_as_it_was_written(spark):
    rng = random.Random(5)

    def toc(depth):
        return {"topic": f"{rng.random()}.md", "title": rng.choice(['a "b"', "[{:,}]", "é\\n"]), "children": [toc(depth - 1) for _ in range(rng.randint(0, 3) if depth else 0)]}

    tops = {"schema": "s", "title": "[x", "topics": {"dir": "d"}, "images": {"dir": "i", "version": "1", "web-path": "w"}}
    texts = [json.dumps({**tops, "instances": [{"id": f"i{k}", "name": "n", "start-page": "p", "toc-elements": [toc(6) for _ in range(2)]} for k in range(2)]}) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "project_id int, content string")
    folders, instances, nodes = json_config.projects(df), json_config.instances(df), json_config.nodes(df)
    blocks = cut_lineage(documents.assemble(documents.config_pieces(folders, instances, nodes), ["project_id"], block=7))
    assert blocks.count() > 20
    values = json_blocks.values(blocks.select("project_id", "block", "content"))
    rows = lambda df, *c: sorted(repr(tuple(r)) for r in df.select(*c).collect())
    columns = ["project_id", "instance_id", "node_path", "topic", "title", "more"]
    assert rows(json_blocks.nodes(values, json_config.MORE), *columns) == rows(nodes, *columns)
    assert rows(json_config.instances_in_blocks(values), *instances.columns) == rows(instances, *instances.columns)
    assert rows(json_config.projects(json_blocks.tops(values)), *folders.columns) == rows(folders, *folders.columns)
    assert json_blocks.violations(values).count() == 0
    assert json_blocks.readability(values).where("not readable").count() == 0


def test_trees_are_walked_once_for_all_tables(spark, monkeypatch):
    walked = []
    walk = json_blocks.tree.from_parents
    monkeypatch.setattr(json_blocks.tree, "from_parents", lambda edges: walked.append(1) or walk(edges))
    text = '{"instances":[{"id":"i","name":"n","toc-elements":[{"topic":"a","children":[{"topic":"b"}]}]}]}'
    head, rest = text.split('"toc', 1)
    values = json_blocks.values(spark.createDataFrame([("p", 0, head), ("p", 1, f'"toc{rest}')], "project_id string, block int, content string"))
    assert [(r.node_path, r.topic) for r in json_blocks.nodes(values, []).orderBy("node_path").collect()] == [([0], "a"), ([0, 0], "b")]
    assert [(r.ordinal, r.id, r.name) for r in json_blocks.instances(values).collect()] == [(0, "i", "n")]
    assert json_blocks.readability(values).first().readable and json_blocks.violations(values).count() == 0
    assert len(walked) == 1
