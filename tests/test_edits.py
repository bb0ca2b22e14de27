"""Edit batches against a small sequential model, on random trees and edits."""

import random

import pytest

from leafwork.functions.text import STUB_BODY
from leafwork.operators import edits as E

NODES = "project_id string, instance_id string, node_path array<int>, topic string, title string"
INSTANCES = "project_id string, instance_id string, name string, start_page string, ordinal int"
EDITS = "project_id string, instance_id string, seq long, op string, topic string, target string, title string, file_name string"
TOPICS = "project_id string, file string, content string"


class Model:
    """One project, edited one step at a time."""

    def __init__(self, trees, instances, files):
        self.trees, self.instances, self.files = trees, instances, files

    @staticmethod
    def walk(siblings, path=()):
        for i, node in enumerate(siblings):
            yield (*path, i), siblings, node
            yield from Model.walk(node["children"], (*path, i))

    def first(self, inst, topic):
        return next((hit for hit in self.walk(self.trees[inst]) if hit[2]["topic"] == topic), None)

    def level_first(self, siblings, topic):
        for node in siblings:
            if node["topic"] == topic:
                return siblings, node
        for node in siblings:
            hit = self.level_first(node["children"], topic)
            if hit:
                return hit
        return None

    def files_of(self, siblings):
        return [node["topic"] for _, _, node in self.walk(siblings)]

    def create(self, file, title):
        self.files.setdefault(file, f"# {title}{STUB_BODY}")

    def apply(self, inst, op, topic, target, title, file_name):
        slug = "-".join((title or "").lower().split()) + ".md"
        if op == "create_instance":
            if inst in self.instances:
                return "id is taken"
            file, n = slug, 0
            while file in self.files:
                n += 1
                file = f"{slug[:-3]}{n}.md"
            self.trees[inst] = [{"topic": file, "title": f"About {title}", "children": []}]
            self.instances[inst] = [title, file]
            self.create(file, f"About {title}")
            return "applied"
        if inst not in self.instances:
            return "instance not found"
        tree = self.trees[inst]
        new = {"topic": file_name or slug, "title": title, "children": []}
        if op == "set_start":
            self.instances[inst][1] = topic
        elif op == "rename_instance":
            self.instances[inst][0] = title
        elif op == "delete_instance":
            for file in self.files_of(tree):
                self.files.pop(file, None)
            del self.trees[inst], self.instances[inst]
        elif op == "add_root":
            tree.append(new)
            self.create(new["topic"], title)
        elif op == "add_child":
            hit = self.first(inst, target)
            if not hit:
                return "target not found"
            hit[2]["children"].append(new)
            self.create(new["topic"], title)
        elif op == "add_sibling":
            hit = self.first(inst, target)
            if not hit:
                return "target not found"
            hit[1].append(new)
            self.create(new["topic"], title)
        elif op == "delete":
            if self.instances[inst][1] == topic:
                return "start page"
            hit = self.level_first(tree, topic)
            if not hit:
                return "topic not found"
            hit[0][:] = [n for n in hit[0] if n is not hit[1]]
            for file in self.files_of([hit[1]]):
                self.files.pop(file, None)
        elif op == "remove":
            hit = self.first(inst, topic)
            if not hit:
                return "topic not found"
            hit[1][:] = [n for n in hit[1] if n is not hit[2]]
        elif op == "move":
            source, goal = self.first(inst, topic), self.first(inst, target)
            if not source:
                return "topic not found"
            if not goal:
                return "target not found"
            if topic == target or goal[0][: len(source[0])] == source[0]:
                return "inside itself"
            if source[1] is goal[2]["children"]:
                return "already there"
            source[1][:] = [n for n in source[1] if n is not source[2]]
            goal[2]["children"].append(source[2])
        else:
            hit = self.first(inst, topic)
            if not hit:
                return "topic not found"
            if len(tree) == 1:
                self.instances[inst][1] = new["topic"]
            hit[2].update(topic=new["topic"], title=title)
            if op == "edit_title" and topic in self.files:
                body = self.files[topic]
                lines = body.split("\n")
                self.files[topic] = "\n".join([f"# {title}", *lines[1:]]) if body.startswith("# ") else f"# {title}\n{body}"
            if topic in self.files and new["topic"] not in self.files:
                self.files[new["topic"]] = self.files.pop(topic)
        return "applied"


def random_project(rng, project, names):
    trees, instances = {}, {}
    for inst in ("a", "b"):
        pool = []
        trees[inst] = []
        for i in range(rng.randint(1, 12)):
            node = {"topic": rng.choice(names), "title": f"t{i}", "children": []}
            spot = rng.choice([trees[inst], *[n["children"] for n in pool]])
            spot.append(node)
            pool.append(node)
        instances[inst] = [f"name {inst}", rng.choice(names)]
    files = {}
    for n in names:
        if rng.random() < 0.6:
            files[n] = rng.choice([f"# Head {n}\nbody", f"no head {n}"])
    return Model(trees, instances, files)


OPS = ["delete", "remove", "add_root", "add_child", "add_sibling", "move", "move", "move", "rename",
       "edit_title", "set_start", "rename_instance", "create_instance", "delete_instance"]


@pytest.mark.parametrize("seed, weights, n_names", [
    (1, None, 40),
    (2, {"move": 8, "add_child": 4, "delete": 2}, 60),
    (3, {"rename": 6, "edit_title": 3, "move": 1, "add_root": 1}, 30),
    (4, None, 6),
    (5, {"rename": 3, "add_root": 3, "create_instance": 3, "delete": 3, "set_start": 3, "edit_title": 1}, 12),
    (6, {"delete_instance": 3, "create_instance": 6, "add_child": 3, "rename": 2, "rename_instance": 2}, 20),
])
def test_batches_equal_the_sequential_model(spark, seed, weights, n_names):
    rng = random.Random(seed)
    names = [f"f{i}.md" for i in range(n_names)]
    models = {f"p{i}": random_project(rng, i, names) for i in range(8)}
    nodes, instances, topics, edits = [], [], [], []
    for p, m in models.items():
        for inst, tree in m.trees.items():
            nodes += [(p, inst, list(path), n["topic"], n["title"]) for path, _, n in m.walk(tree)]
        instances += [(p, inst, *row, i) for i, (inst, row) in enumerate(m.instances.items())]
        topics += [(p, f, c) for f, c in m.files.items()]
    choices = list(weights) if weights else OPS
    expected = []
    for seq in range(4 * len(models)):
        p = rng.choice(list(models))
        op = rng.choices(choices, weights and list(weights.values()))[0]
        if op.endswith("_instance") and rng.random() < 0.5:
            op = "add_child"
        inst = rng.choice(["a", "b", "b", "c"] if op == "create_instance" else ["a", "b"])
        topic, target = rng.choice(names), rng.choice(names)
        title = f"New {rng.choice(names)[:-3]}"
        file_name = rng.choice([None, rng.choice(names)])
        edit = (op, topic, target, title, file_name)
        edits.append((p, inst, seq, *edit))
        expected.append((p, seq, models[p].apply(inst, *edit)))

    topics_df = spark.createDataFrame(topics, TOPICS)
    corpus = E.corpus_of(spark.createDataFrame(nodes, NODES), spark.createDataFrame(instances, INSTANCES), topics_df)
    result = E.apply_edits(corpus, spark.createDataFrame(edits, EDITS))

    got = sorted((r.project_id, r.seq, r.status) for r in result.outcomes.collect())
    wrong = [(g, w, edits[w[1]]) for g, w in zip(got, sorted(expected)) if g != w]
    assert not wrong, wrong[:5]
    tree_rows = {(r.project_id, r.instance_id, tuple(r.node_path), r.topic, r.title) for r in result.corpus.nodes.collect()}
    assert tree_rows == {
        (p, inst, path, n["topic"], n["title"])
        for p, m in models.items() for inst, tree in m.trees.items() for path, _, n in m.walk(tree)
    }
    rows = {(r.project_id, r.instance_id, r.name, r.start_page) for r in result.corpus.instances.collect()}
    assert rows == {(p, i, *row) for p, m in models.items() for i, row in m.instances.items()}
    contents = {(r.project_id, r.file, r.content) for r in E.materialise(result.corpus.files, topics_df).collect()}
    assert contents == {(p, f, c) for p, m in models.items() for f, c in m.files.items()}


def six_nodes(spark):
    nodes = [("p", "a", [i], f"r{i}.md", f"r{i}") for i in range(2)]
    nodes += [("p", "a", [0, i], f"c{i}.md", f"c{i}") for i in range(4)]
    return E.corpus_of(
        spark.createDataFrame(nodes, NODES),
        spark.createDataFrame([("p", "a", "A", "r0.md", 0)], INSTANCES),
        spark.createDataFrame([("p", n[3], "# x") for n in nodes], TOPICS),
    )


def test_kinds_commute_and_rounds_follow_dependence(spark):
    """Alternating kinds of which one pair depends on each other take two rounds."""
    edits = []
    for i in range(4):
        edits.append(("p", "a", 2 * i, "add_root", None, None, f"New {i}", None))
        edits.append(("p", "a", 2 * i + 1, "rename", "new-0.md" if i == 3 else f"c{i}.md", None, f"Other {i}", None))
    result = E.apply_edits(six_nodes(spark), spark.createDataFrame(edits, EDITS))
    assert {r.status for r in result.outcomes.collect()} == {"applied"}
    assert result.rounds <= 2


def test_independent_creations_take_one_round(spark):
    edits = [("p", f"i{k}", k, "create_instance", None, None, "Same Title", None) for k in range(6)]
    result = E.apply_edits(six_nodes(spark), spark.createDataFrame(edits, EDITS))
    assert result.rounds == 1
    pages = sorted(r.start_page for r in result.corpus.instances.where("instance_id != 'a'").collect())
    assert pages == ["same-title.md", *(f"same-title{k}.md" for k in range(1, 6))]


def chain_of(kind, n):
    """``n`` edits of one node, each after the other, and the same step by step."""
    if kind == "rename":
        return [("p", "a", k, "edit_title" if k % 3 == 1 else "rename", f"s{k}.md" if k else "c0.md", None, f"S{k + 1}", None) for k in range(n)]
    goals = ["r1.md", "c1.md", "c1.md", "c0.md", "none.md", "r0.md", "c3.md"]
    return [("p", "a", k, "move", "c0.md", goals[k % len(goals)], None, None) for k in range(n)]


@pytest.mark.parametrize("kind", ["rename", "move"])
def test_chains_take_few_rounds_and_equal_single_steps(spark, kind):
    steps = chain_of(kind, 100)
    model = Model(
        {"a": [{"topic": "r0.md", "title": "r0", "children": [{"topic": f"c{i}.md", "title": f"c{i}", "children": []} for i in range(4)]}, {"topic": "r1.md", "title": "r1", "children": []}]},
        {"a": ["A", "r0.md"]}, {f: "# x" for f in ("r0.md", "r1.md", "c0.md", "c1.md", "c2.md", "c3.md")},
    )
    expected = [(e[2], model.apply("a", *e[3:])) for e in steps]
    result = E.apply_edits(six_nodes(spark), spark.createDataFrame(steps, EDITS))
    assert result.rounds <= 8
    assert sorted((r.seq, r.status) for r in result.outcomes.collect()) == expected
    assert {(tuple(r.node_path), r.topic, r.title) for r in result.corpus.nodes.collect()} == {(p, n["topic"], n["title"]) for p, _, n in model.walk(model.trees["a"])}
    topics = spark.createDataFrame([("p", f"{c}{i}.md", "# x") for c, n in (("r", 2), ("c", 4)) for i in range(n)], TOPICS)
    assert {(r.file, r.content) for r in E.materialise(result.corpus.files, topics).collect()} == set(model.files.items())


@pytest.mark.parametrize("seed", range(2))
def test_random_chains_equal_the_sequential_model(spark, seed):
    """Chains broken by other edits of the tree and the project, with names in use."""
    rng = random.Random(100 + seed)
    names = [f"f{i}.md" for i in range(8)]
    models = {f"p{i}": random_project(rng, i, names) for i in range(6)}
    nodes, instances, topics = [], [], []
    for p, m in models.items():
        for inst, tree in m.trees.items():
            nodes += [(p, inst, list(path), n["topic"], n["title"]) for path, _, n in m.walk(tree)]
        instances += [(p, inst, *row, i) for i, (inst, row) in enumerate(m.instances.items())]
        topics += [(p, f, c) for f, c in m.files.items()]
    edits, expected, at = [], [], {}
    for seq in range(45):
        p, inst = rng.choice(list(models)), rng.choice("ab")
        chain = (p, inst, rng.randint(0, 1))
        now = at.get(chain, rng.choice(names))
        if rng.random() < 0.75:
            new = rng.choice([f"g{seq}.md", f"g{seq}.md", f"g{seq}.md", now, rng.choice(names)])
            edit = (rng.choice(["rename", "edit_title"]), now, None, f"T {seq}", new)
            at[chain] = new
        elif rng.random() < 0.5:
            edit = ("move", now, rng.choice(names), None, None)
        else:
            edit = (rng.choice(["delete", "remove", "add_root", "add_child", "set_start", "create_instance", "rename_instance"]), rng.choice([now, *names]), rng.choice(names), f"N {seq}", rng.choice([None, now, f"g{seq + 1}.md"]))
        edits.append((p, inst, seq, *edit))
        expected.append((p, seq, models[p].apply(inst, *edit)))
    topics_df = spark.createDataFrame(topics, TOPICS)
    corpus = E.corpus_of(spark.createDataFrame(nodes, NODES), spark.createDataFrame(instances, INSTANCES), topics_df)
    result = E.apply_edits(corpus, spark.createDataFrame(edits, EDITS))
    got = sorted((r.project_id, r.seq, r.status) for r in result.outcomes.collect())
    wrong = [(g, w, edits[w[1]]) for g, w in zip(got, sorted(expected)) if g != w]
    assert not wrong, wrong[:5]
    rows = {(r.project_id, r.instance_id, tuple(r.node_path), r.topic, r.title) for r in result.corpus.nodes.collect()}
    assert rows == {(p, inst, path, n["topic"], n["title"]) for p, m in models.items() for inst, tree in m.trees.items() for path, _, n in m.walk(tree)}
    pages = {(r.project_id, r.instance_id, r.name, r.start_page) for r in result.corpus.instances.collect()}
    assert pages == {(p, i, *row) for p, m in models.items() for i, row in m.instances.items()}
    contents = {(r.project_id, r.file, r.content) for r in E.materialise(result.corpus.files, topics_df).collect()}
    assert contents == {(p, f, c) for p, m in models.items() for f, c in m.files.items()}


def test_new_instances_may_take_the_names_of_a_chain(spark):
    """The first free name of a new instance is one that a chain of renames goes through."""
    steps = [
        ("p", "b", 0, "create_instance", None, None, "c0", None),  # c0.md is taken: c01.md
        ("p", "a", 1, "rename", "c1.md", None, "T1", "c01.md"), ("p", "a", 2, "rename", "c01.md", None, "T2", "z.md"),
        ("p", "a", 3, "rename", "c2.md", None, "T3", "y1.md"), ("p", "a", 4, "rename", "y1.md", None, "T4", "y2.md"),
    ]
    model = Model(
        {"a": [{"topic": "r0.md", "title": "r0", "children": [{"topic": f"c{i}.md", "title": f"c{i}", "children": []} for i in range(4)]}, {"topic": "r1.md", "title": "r1", "children": []}]},
        {"a": ["A", "r0.md"]}, {f: "# x" for f in ("r0.md", "r1.md", "c0.md", "c1.md", "c2.md", "c3.md")},
    )
    for e in steps:
        assert model.apply(e[1], *e[3:]) == "applied"
    result = E.apply_edits(six_nodes(spark), spark.createDataFrame(steps, EDITS))
    assert {r.status for r in result.outcomes.collect()} == {"applied"}
    topics = spark.createDataFrame([("p", f"{c}{i}.md", "# x") for c, n in (("r", 2), ("c", 4)) for i in range(n)], TOPICS)
    assert {(r.file, r.content) for r in E.materialise(result.corpus.files, topics).collect()} == set(model.files.items())
