"""Tree operators, lookups, names and slice-wise windows."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwork.operators import instances, lookup, naming, skew, tree
from leafwork.session import cut_lineage

NODES = "project_id string, instance_id string, node_path array<int>, topic string, title string"


def nodes_of(spark, rows):
    return spark.createDataFrame([("p", "i", path, topic, None) for path, topic in rows], NODES)


def test_a_cycle_beside_many_nodes_grows_no_long_path(spark, monkeypatch):
    rows = [("p", "i", n, None, n) for n in range(300)] + [("p", "i", 300, 0, 0), ("p", "i", 301, 300, 0), ("p", "i", 900, 901, 0), ("p", "i", 901, 900, 0)]
    edges = spark.createDataFrame(rows, "project_id string, instance_id string, node long, parent long, ordinal int")
    lengths = []

    def noted(df):
        kept = cut_lineage(df)
        lengths.append(kept.agg(F.max(F.size("node_path"))).first()[0])
        return kept

    monkeypatch.setattr(tree, "cut_lineage", noted)
    got = {r.node: r.node_path for r in tree.from_parents(edges).collect()}
    assert got == {n: [n] for n in range(300)} | {300: [0, 0], 301: [0, 0, 0]}
    assert max(lengths) <= 8


def test_from_parents_leaves_out_orphans_and_cycles(spark):
    edges = spark.createDataFrame(
        [("p", "i", n, parent, o) for n, parent, o in [(1, None, 0), (2, 1, 1), (3, 2, 0), (4, 99, 0), (5, 6, 0), (6, 5, 0), (7, 1, 0)]],
        "project_id string, instance_id string, node long, parent long, ordinal int",
    )
    got = {r.node: r.node_path for r in tree.from_parents(edges).collect()}
    assert got == {1: [0], 2: [0, 1], 3: [0, 1, 0], 7: [0, 0]}


def test_deep_chain(spark):
    edges = spark.range(30).selectExpr(
        "'p' as project_id", "'i' as instance_id", "id as node", "if(id = 0, null, id - 1) as parent", "0 as ordinal"
    )
    assert tree.from_parents(edges).agg(F.max(F.size("node_path"))).first()[0] == 30


def test_search_orders_differ_for_repeated_topics(spark):
    nodes = nodes_of(spark, [([0], "a"), ([0, 0], "x"), ([1], "x")])
    assert lookup.first_match(nodes).where("topic = 'x'").first().node_path == [0, 0]
    assert lookup.first_match(nodes, order="level").where("topic = 'x'").first().node_path == [1]


def test_parent_of_a_deep_node(spark):
    nodes = nodes_of(spark, [([0], "a"), ([0, 0], "b"), ([0, 0, 0], "c")])
    real = {r.topic: r.up_topic for r in tree.parents(nodes).collect()}
    original = {r.topic: r.up_topic for r in tree.parents(nodes, mode="reference").collect()}
    assert real == {"a": None, "b": "a", "c": "b"}
    assert original == {"a": None, "b": "a", "c": "a"}


def test_renumber_and_outside(spark):
    nodes = nodes_of(spark, [([0], "a"), ([2], "b"), ([2, 5], "c"), ([2, 9], "d"), ([7], "e")])
    got = {r.topic: r.node_path for r in tree.renumber(nodes).collect()}
    assert got == {"a": [0], "b": [1], "c": [1, 0], "d": [1, 1], "e": [2]}
    left = tree.outside(nodes, nodes.where("topic = 'b'"))
    assert {r.topic for r in left.collect()} == {"a", "e"}


def test_slice_windows_equal_plain_windows(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaab"), i, rng.choice([None, "x", "y", "z"]), rng.randint(0, 50)) for i in rng.sample(range(4000), 700)]
    df = spark.createDataFrame(rows, "k string, seq long, v string, m int")
    whole = W.partitionBy("k").orderBy("seq")
    plain = df.select("k", "seq", F.row_number().over(whole).cast("long").alias("n"), F.lag("v").over(whole).alias("l"),
                      F.max("m").over(whole.rowsBetween(W.unboundedPreceding, 0)).alias("x"))
    numbered = skew.split_row_number(df, ["k"], "seq", "n")
    lagged = skew.split_lag(numbered, ["k"], ["seq"], {"l": "v"})
    ours = skew.split_running_max(lagged, ["k"], ["seq"], "m", "x").select("k", "seq", "n", "l", "x")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, plain.collect()))


def test_names_equal_serving_one_by_one(spark):
    rng = random.Random(9)
    titles = ["a", "A", "a1", "a 1", " a", "b", "a11"]
    used = {("p", f) for f in ["a.md", "a2.md", "a11.md", "b1.md", "b01.md"]}
    asked = [(rng.choice("pq"), i, rng.choice(titles)) for i in range(40)]
    taken, expected = set(used), []
    for project, seq, title in asked:
        stem = title.lower().replace(" ", "-")
        name, n = title.strip().lower().replace(" ", "-") + ".md", 0
        while (project, name) in taken:
            n += 1
            name = f"{stem}{n}.md"
        taken.add((project, name))
        expected.append((project, seq, name))
    got = naming.unique_files(
        spark.createDataFrame(asked, "project_id string, seq long, title string"),
        spark.createDataFrame(sorted(used), "project_id string, file string"),
    )
    assert sorted((r.project_id, r.seq, r.file) for r in got.collect()) == sorted(expected)


def test_instance_id_suggestions(spark):
    asked = spark.createDataFrame([("p", 1, "md"), ("p", 2, "md"), ("p", 3, "x"), ("q", 4, "md")], "project_id string, seq long, wanted_id string")
    taken = spark.createDataFrame([("p", "md"), ("p", "md12")], "project_id string, instance_id string")
    got = {r.seq: r.instance_id for r in naming.unique_instance_ids(asked, taken).collect()}
    assert got == {1: "md1", 2: "md123", 3: "x", 4: "md"}


def test_many_instance_ids_are_kept_as_numbers(spark, monkeypatch):
    """Names grow with the numbers before them; none is written, and stems that meet are told apart."""
    written = []
    cut = naming.cut_lineage
    monkeypatch.setattr(naming, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    asked = [(i % 2 and "p" or "q", i, ("a", "a1", "a12", "b9", "a12345678910")[i * 7 % 5]) for i in range(400)]
    used = {("p", "a1"), ("p", "a123"), ("q", "a12"), ("q", "b9123456")}
    suffix = lambda n: "".join(map(str, range(1, n + 1)))
    taken, expected = set(used), []
    for project, seq, wanted in asked:
        n = 0
        while (project, wanted + suffix(n)) in taken:
            n += 1
        taken.add((project, wanted + suffix(n)))
        expected.append((project, seq, wanted + suffix(n)))
    got = naming.unique_instance_ids(
        spark.createDataFrame(asked, "project_id string, seq long, wanted_id string"),
        spark.createDataFrame(sorted(used), "project_id string, instance_id string"),
    )
    assert sorted((r.project_id, r.seq, r.instance_id) for r in got.collect()) == sorted(expected)
    longest = [df.agg(*[F.coalesce(F.max(F.length(c)), F.lit(0)) for c, kind in df.dtypes if kind == "string"]).first() for df in written]
    assert max(max(row) for row in longest) <= 64 < max(len(name) for _, _, name in expected)


def test_wanted_nodes_are_found_in_either_order(spark):
    nodes = nodes_of(spark, [([0], "a"), ([0, 0], "t"), ([1], "t"), ([2], "b")])
    wanted = spark.createDataFrame([("p", "i", "t"), ("p", "i", "none")], "project_id string, instance_id string, topic string")
    found = {r.topic: r.node_path for r in lookup.find_nodes(wanted, nodes).collect()}
    assert found == {"t": [0, 0], "none": None}
    assert {r.topic: r.node_path for r in lookup.find_nodes(wanted, nodes, order="level").collect()}["t"] == [1]


def test_created_instances_are_registered_last(spark):
    registry = spark.createDataFrame([("p", 0, "a.tree"), ("p", 4, "b.tree")], "project_id string, ordinal int, src string")
    created = spark.createDataFrame([("p", "z", 9), ("p", "y", 3), ("q", "x", 5)], "project_id string, instance_id string, seq long")
    got = {(r.project_id, r.ordinal, r.src) for r in instances.register(created, registry).collect()}
    assert got == {("p", 0, "a.tree"), ("p", 4, "b.tree"), ("p", 5, "y.tree"), ("p", 6, "z.tree"), ("q", 0, "x.tree")}
