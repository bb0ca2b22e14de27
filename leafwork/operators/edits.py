"""Ordered edit batches applied to the trees of many projects at once.

Edits of one project are ordered by ``seq``, but most of them do not depend on
each other. Each round finds, for all projects together, the pending edits that
commute with every earlier pending edit, whatever their kinds, and applies these
set-wise; so the number of rounds is the length of the longest chain of edits that
depend on each other, and no task ever holds a whole tree or a whole project's edits.
Renames that go on from each other, and moves of one node in a row, are taken together
first (``chains``), so that they count as one link of such a chain.
A round writes the trees and projects that still have edits pending, no others.

Two edits depend on each other when they meet in one of these, see ``_uses``: a node
that one takes away and the other has on its way to the root; a name that one brings
into a tree and the other looks up there; a file of the project that one creates,
renames or deletes and the other too; a tree's start page or last root; the existence
of an instance. Whatever an earlier edit may later be moved below is part of some
earlier pending edit's own way to the root, so the test on the current trees is enough.

New and moved nodes go last in their sibling list. Their position is taken from
``seq``, beyond every stored position, so that the order is right whichever round
applies them; the gaps are closed once, at the end.

Columns of ``edits``: project_id, instance_id, seq (whole number, at least 0,
unique per project), op, topic, target, title, file_name. Operations:

===============  ==================================================================
delete           take out ``topic`` (found level by level) with its subtree and files
remove           take out ``topic`` (found in document order) with its subtree only
add_root         new root ``file_name`` (default: from ``title``)
add_child        new child of ``target``
add_sibling      new node next to ``target``
move             put ``topic`` last among the children of ``target``
rename           give ``topic`` a new title and file (``file_name`` or from ``title``)
edit_title       the same, and rewrite the heading in the file
set_start        make ``topic`` the start page
rename_instance  new instance name ``title``
create_instance  new instance ``title`` with one root
delete_instance  drop the instance, its tree and its files
===============  ==================================================================

A repeated topic is the first one in document order (``delete``: level by level).
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions import paths as P
from leafwork.functions import text as X
from leafwork.operators import chains, naming, tree
from leafwork.operators.tree import NODE, TREE
from leafwork.session import cut_lineage

NODE_COLUMNS = [*NODE, "topic", "title", "more"]
INSTANCE_COLUMNS = [*TREE, "name", "start_page", "ordinal"]
EDIT_COLUMNS = [*TREE, "seq", "op", "topic", "target", "title", "file_name"]
# Positions of appended nodes start beyond the largest stored position (int).
APPENDED = 1 << 31
_COMPACT = 8  # rounds after which tables are written anew

_STRUCTURE = ("delete", "remove", "add_root", "add_child", "add_sibling", "move")
_LABEL = ("rename", "edit_title")
_SETTING = ("set_start", "rename_instance")
_ADD = ("add_root", "add_child", "add_sibling", "create_instance")


class Corpus(NamedTuple):
    """Trees, instances and file names of a set of projects.

    A node's other fields (``more``) go with it.
    ``files`` holds names only: ``origin`` is the file whose content a file
    carries (NULL for a new one), ``stub_title`` the title of a new file and
    ``heading`` a title to write into it. Contents are joined once, afterwards.
    """

    nodes: DataFrame
    instances: DataFrame
    files: DataFrame


class Result(NamedTuple):
    corpus: Corpus
    outcomes: DataFrame
    """Each edit with ``status``: ``applied`` or the reason why it was refused."""
    rounds: int


def corpus_of(nodes: DataFrame, instances: DataFrame, topics: DataFrame) -> Corpus:
    if "more" not in nodes.columns:
        nodes = nodes.withColumn("more", F.lit(None).cast("map<string,string>"))
    return Corpus(
        nodes.select(*NODE_COLUMNS),
        instances.select(*INSTANCE_COLUMNS),
        topics.select(
            "project_id",
            "file",
            F.col("file").alias("origin"),
            F.lit(None).cast("string").alias("stub_title"),
            F.lit(None).cast("string").alias("heading"),
        ),
    )


def apply_edits(corpus: Corpus, edits: DataFrame, sibling_parent: str = "corrected") -> Result:
    """Apply an ordered batch of edits to all projects.

    ``sibling_parent='reference'`` makes ``add_sibling`` use the topmost ancestor
    as parent for nodes below the second level, as the original lookup does.
    """
    touched = edits.select("project_id").distinct()

    def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        return df.join(touched, "project_id", "left_semi"), df.join(touched, "project_id", "left_anti")

    active, idle = zip(*(split(df) for df in corpus))
    nodes = cut_lineage(active[0].withColumn("node_path", F.col("node_path").cast("array<bigint>")))
    work = Corpus(nodes, cut_lineage(active[1]), cut_lineage(active[2]))
    given = cut_lineage(edits.select(*EDIT_COLUMNS))
    pending, members, runs = chains.chained(given, work.nodes, work.files)
    done: list[DataFrame] = []
    finished: list[Corpus] = []
    rounds = 0
    while not pending.isEmpty():
        ready = _ready(work, pending, sibling_parent)
        ready = cut_lineage(chains.settled_moves(ready) if runs else ready.withColumn("last", F.lit(True)))
        rounds += 1
        work = _apply(work, ready)
        done.append(ready.select(*EDIT_COLUMNS, "status"))
        pending = cut_lineage(pending.join(ready, ["project_id", "seq"], "left_anti"))
        if pending.isEmpty():
            break
        # Trees without pending edits are through; they are not written again.
        trees, projects = pending.select(*TREE).distinct(), pending.select("project_id").distinct()
        finished.append(Corpus(*(df.join(keys, on, "left_anti") for df, keys, on in _by_scope(work, trees, projects))))
        work = Corpus(*(df.join(keys, on, "left_semi") for df, keys, on in _by_scope(work, trees, projects)))
        if rounds % _COMPACT == 0:  # so that no plan grows with the rounds
            done = [cut_lineage(_union(done))]
            finished = [Corpus(*(cut_lineage(_union(parts)) for parts in zip(*finished)))]
            work = Corpus(*map(cut_lineage, work))
    finished.append(work)
    ended = Corpus(*map(_union, zip(*finished)))
    numbered = tree.renumber(ended.nodes).withColumn(
        "node_path", F.col("node_path").cast(P.PATH_TYPE)
    )
    merged = Corpus(
        idle[0].unionByName(numbered),
        idle[1].unionByName(ended.instances),
        idle[2].unionByName(ended.files),
    )
    outcomes = _union(done) if done else edits.select(*EDIT_COLUMNS, F.lit("").alias("status"))
    if members is not None:  # each edit of a chain shares its outcome
        shared = outcomes.select("project_id", F.col("seq").alias("unit"), "status").join(members, ["project_id", "unit"]).drop("unit")
        alone = outcomes.join(members, ["project_id", "seq"], "left_anti")
        outcomes = alone.unionByName(given.join(shared, ["project_id", "seq"]).select(*alone.columns))
    return Result(merged, outcomes, rounds)


def _by_scope(work: Corpus, trees: DataFrame, projects: DataFrame) -> list[tuple[DataFrame, DataFrame, list[str]]]:
    return [(work.nodes, trees, TREE), (work.instances, trees, TREE), (work.files, projects, ["project_id"])]


def materialise(files: DataFrame, topics: DataFrame) -> DataFrame:
    """Topic contents after a batch: one join of names with the stored contents."""
    stored = topics.select("project_id", F.col("file").alias("origin"), "content")
    kept = files.where("origin is not null").join(stored, ["project_id", "origin"])
    body = F.when(F.col("heading").isNotNull(), X.set_title(F.col("content"), F.col("heading")))
    fresh = X.stub(F.col("stub_title"))
    new = F.when(F.col("heading").isNotNull(), X.set_title(fresh, F.col("heading"))).otherwise(fresh)
    return kept.select("project_id", "file", F.coalesce(body, "content").alias("content")).unionByName(
        files.where("origin is null").select("project_id", "file", new.alias("content"))
    )


# One round -----------------------------------------------------------------


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _kind(op: Column) -> Column:
    return (
        F.when(op.isin(*_STRUCTURE), "structure")
        .when(op.isin(*_LABEL), "label")
        .when(op.isin(*_SETTING), "setting")
        .otherwise("instance")
    )


def _located(work: Corpus, pending: DataFrame, sibling_parent: str) -> DataFrame:
    """Add the nodes that each edit refers to, and its status.

    ``source``: node taken away or relabelled; ``parent``: path of the node that
    receives a child (empty for a new root).
    """
    run = pending.withColumn("kind", _kind(F.col("op")))
    wanted = (
        run.select(*TREE, F.explode(F.array("topic", "target")).alias("topic"))
        .where("topic is not null")
        .distinct()
    )
    path = F.col("node_path")
    places = (
        work.nodes.join(wanted, [*TREE, "topic"], "left_semi")
        .groupBy(*TREE, "topic")
        .agg(
            F.min(path).alias("first"),
            F.min_by(path, P.level_first_key(path)).alias("level"),
            F.count(F.lit(1)).alias("copies"),
        )
    )
    of_topic = places.select(
        *TREE, "topic", F.col("first").alias("t_first"), F.col("level").alias("t_level"), F.col("copies").alias("t_copies")
    )
    of_target = places.select(
        *TREE, F.col("topic").alias("target"), F.col("first").alias("g_first"), F.col("copies").alias("g_copies")
    )
    homes = work.instances.select(*TREE, "start_page", F.lit(True).alias("known"))
    up = P.root_of if sibling_parent == "reference" else P.parent_of
    op = F.col("op")
    no_path = F.lit(None).cast("array<bigint>")
    root_list = F.array().cast("array<bigint>")
    joined = (
        run.join(of_topic, [*TREE, "topic"], "left")
        .join(of_target, [*TREE, "target"], "left")
        .join(homes, TREE, "left")
    )
    source = (
        F.when(op == "delete", F.col("t_level"))
        .when(op.isin("remove", "move", *_LABEL), F.col("t_first"))
        .otherwise(no_path)
    )
    parent = (
        F.when(op.isin("add_child", "move"), F.col("g_first"))
        .when(op == "add_root", root_list)
        .when(op == "add_sibling", F.when(F.size("g_first") == 1, root_list).otherwise(up(F.col("g_first"))))
        .otherwise(no_path)
    )
    placed = joined.withColumns({"source": source, "parent": parent, "new_file": chains.new_name()})
    below_itself = F.slice("parent", F.lit(1), F.size("source")) == F.col("source")
    status = (
        F.when(op == "create_instance", F.when(F.col("known"), "id is taken").otherwise("applied"))
        .when(F.col("known").isNull(), "instance not found")
        .when((op == "delete") & (F.col("start_page") == F.col("topic")), "start page")
        .when(op.isin("delete", "remove", "move", *_LABEL) & F.col("source").isNull(), "topic not found")
        .when(op.isin("add_child", "add_sibling", "move") & F.col("parent").isNull(), "target not found")
        .when((op == "move") & ((F.col("topic") == F.col("target")) | below_itself), "inside itself")
        .when((op == "move") & (P.parent_of(F.col("source")) == F.col("parent")), "already there")
        .otherwise("applied")
    )
    return placed.withColumn("status", status)


def _ready(work: Corpus, pending: DataFrame, sibling_parent: str) -> DataFrame:
    """Edits that commute with every earlier pending edit."""
    # Used by several tests below, so it is written once.
    located = cut_lineage(_located(work, pending, sibling_parent))
    held = _later_of_pairs(_uses(work, located), located)
    # A lookup of a repeated name depends on the whole tree: it waits for all
    # earlier edits of the tree, and all later ones wait for it.
    repeated = F.coalesce((F.col("t_copies") > 1) | (F.col("g_copies") > 1), F.lit(False)) & F.col("kind").isin("structure", "label")
    barriers = located.groupBy(*TREE).agg(
        F.min(F.when(repeated, F.col("seq"))).alias("barrier"), F.min("seq").alias("head_seq")
    )
    return (
        located.join(held, ["project_id", "unit"], "left_anti")
        .join(barriers, TREE)
        .where("barrier is null or seq < barrier or (seq = barrier and seq = head_seq)")
        .drop("barrier", "head_seq")
    )


def _uses(work: Corpus, located: DataFrame) -> DataFrame:
    """What each edit does to what: scope (project_id, what, instance_id, name or node),
    seq, and in which of two roles. Edits in different roles depend on each other."""
    kind, op = F.col("kind"), F.col("op")
    is_label, adds = kind == "label", op.isin(*_ADD) & (op != "create_instance")
    found = F.col("source").isNotNull()
    takes = op.isin("delete", "remove", "move")
    drops = op.isin("delete", "remove")
    no_node = F.lit(None).cast("array<bigint>")
    yes, no = F.lit(True), F.lit(False)

    def use(what: str, when: Column, name: Column, one: Column, other: Column, tree: bool = True) -> Column:
        return F.when(
            when & name.isNotNull(),
            F.struct(
                F.lit(what).alias("what"),
                (F.col("instance_id") if tree else F.lit("")).alias("scope"),
                name.cast("string").alias("name"),
                no_node.alias("node"),
                one.alias("one"),
                other.alias("other"),
            ),
        )

    topic, target, new = F.col("topic"), F.col("target"), F.col("new_file")
    page_set = (op == "set_start") | (is_label & (F.col("n_roots") == 1))
    # Renaming moves the start page of a tree with one root only: adding and taking roots
    # matters to it while the tree has one, or may be left with one.
    unsure = (F.col("n_roots") <= 1) | (F.col("n_roots") - F.col("root_takers") < 2)
    root_change = (F.size("parent") == 0) & adds | takes & (F.size("source") == 1)
    roots = tree.root_counts(work.nodes).select(*TREE, "n_roots")
    takers = located.where(takes & (F.size("source") == 1)).groupBy(*TREE).agg(F.count(F.lit(1)).alias("root_takers"))
    known = (
        located.join(roots, TREE, "left")
        .join(takers, TREE, "left")
        .withColumns({"n_roots": F.coalesce("n_roots", F.lit(0)), "root_takers": F.coalesce("root_takers", F.lit(0))})
    )
    plain = known.select(
        "project_id",
        "seq",
        F.explode(
            F.array(
                # Names in a tree: brought in, looked up.
                use("name", is_label | (kind == "structure"), topic, is_label & found, yes),
                use("name", kind == "structure", target, no, yes),
                use("name", is_label | adds, new, yes, no),
                # Files of the project: renamed from or to, by two renames; created and renamed.
                use("rename", is_label, topic, found, yes, tree=False),
                use("rename", is_label, new, yes, no, tree=False),
                use("create", is_label, topic, yes, no, tree=False),
                use("create", is_label, new, yes, no, tree=False),
                use("create", adds, new, no, yes, tree=False),
                # Files dropped (the other role is below) against files created or renamed.
                use("drop", is_label, topic, no, yes, tree=False),
                use("drop", is_label | adds, new, no, yes, tree=False),
                # A new instance looks for a free file name: its own, or that with a number.
                use("free", op == "create_instance", _stem(new), yes, no, tree=False),
                # Start pages are set, and not deleted.
                use("page", page_set, F.coalesce("start_page", F.lit("")), yes, no),
                use("page", op == "set_start", topic, yes, no),
                use("page", is_label & (F.col("n_roots") == 1), new, yes, no),
                use("page", op == "delete", topic, no, yes),
                use("root", unsure & root_change, F.lit(""), yes, no),
                use("root", unsure & is_label, F.lit(""), no, yes),
                use("tree", op.isNotNull(), F.lit(""), op.isin("create_instance", "delete_instance"), yes),
            )
        ).alias("u"),
    )

    files = known.where(is_label | adds).select("project_id", "seq", F.explode(F.array_distinct(F.array(F.when(is_label, topic), new))).alias("file"))
    numbered = files.where("file is not null").select("project_id", "seq", F.explode(_stems(F.col("file"))).alias("stem"))

    # Ways to the root, against nodes that are taken away. A node that moves only matters
    # where something is put below it, or to what takes it too: what is taken out from
    # below it goes its own way, whichever of the two comes first.
    empty = F.array().cast("array<array<bigint>>")
    to_parent = F.coalesce(F.when(F.size("parent") > 0, P.prefixes(F.col("parent"))), empty)
    way = F.array_union(F.coalesce(P.prefixes(F.col("source")), empty), to_parent)
    on_way = located.where("kind in ('structure', 'label')").withColumns({"way": way, "to_parent": to_parent}).withColumn("node", F.explode("way"))
    here = F.coalesce(F.col("node") == F.col("source"), no)
    is_move = op == "move"

    def ways(what: str, rows: DataFrame, one: Column, other: Column) -> DataFrame:
        return rows.select(
            "project_id", "seq", F.lit(what).alias("what"), F.col("instance_id").alias("scope"),
            F.lit(None).cast("string").alias("name"), "node", one.alias("one"), other.alias("other"),
        )

    put = here | F.array_contains("to_parent", F.col("node"))
    moving = ways("way", on_way.where((kind == "structure") & put), is_move & here, yes)
    going = ways("gone", on_way, drops & here, yes)

    # Files that a delete drops: those of the subtree, or of the whole instance. Only names
    # that another edit of the batch touches matter.
    touched = plain.where("u.what = 'drop' or u.what = 'free'")
    names = touched.where("u.what = 'drop'").select("project_id", F.col("u.name").alias("topic")).distinct()
    stems = touched.where("u.what = 'free'").select("project_id", F.col("u.name").alias("stem")).distinct()
    holders = work.nodes.select(*NODE, "topic")
    deleted = located.where("op = 'delete' and source is not null").select(*TREE, "source", "seq")
    ended = located.where("op = 'delete_instance'").select(*TREE, "seq")

    def named(what: str, rows: DataFrame, name: str, one: Column, other: Column) -> DataFrame:
        return rows.select(
            "project_id", "seq", F.lit(what).alias("what"), F.lit("").alias("scope"), F.col(name).alias("name"),
            no_node.alias("node"), one.alias("one"), other.alias("other"),
        )

    def dropped(rows: DataFrame, name: str) -> DataFrame:
        below = rows.withColumn("source", F.explode(P.prefixes(F.col("node_path")))).join(deleted, [*TREE, "source"])
        lost = below.select("project_id", "seq", name).unionByName(rows.join(ended, TREE).select("project_id", "seq", name))
        return lost.distinct()

    by_stem = holders.withColumn("stem", F.explode(_stems(F.col("topic")))).join(stems, ["project_id", "stem"])
    return _union([
        plain.where("u is not null").select("project_id", "seq", "u.*"),
        moving,
        going,
        named("free", numbered, "stem", no, yes),
        named("drop", dropped(holders.join(names, ["project_id", "topic"]), "topic"), "topic", yes, no),
        named("free", dropped(by_stem, "stem"), "stem", no, yes),
    ])


def _stem(file: Column) -> Column:
    return F.regexp_replace(file, r"\.md$", "")


def _stems(file: Column) -> Column:
    """A file's name, and the names it may be a numbered alternative of."""
    digits = F.length(F.regexp_extract(_stem(file), "[0-9]*$", 0))
    return F.transform(F.sequence(F.lit(0), digits), lambda k: F.left(_stem(file), F.length(_stem(file)) - k))


def _later_of_pairs(uses: DataFrame, located: DataFrame) -> DataFrame:
    """(project_id, unit) of edits that meet one before their unit in the other role."""
    keys = ["project_id", "what", "scope", "name", "node"]
    uses = cut_lineage(uses.join(located.select("project_id", "seq", "unit"), ["project_id", "seq"]))
    firsts = uses.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.min(F.when(F.col("one"), F.col("seq"))).alias("_one"),
        F.min(F.when(F.col("other"), F.col("seq"))).alias("_other"),
    ).where("_one is not null and _other is not null")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return (
        uses.join(firsts, same)
        .where("(other and _one < unit) or (one and _other < unit)")
        .select("project_id", "unit")
        .distinct()
    )


def _apply(work: Corpus, ready: DataFrame) -> Corpus:
    """Apply one round of independent edits, writing only the tables they change."""
    ok = ready.where("status = 'applied' and last")
    # At most one row per kind of operation reaches the driver.
    ops = {row.op for row in ok.select("op").distinct().collect()}
    if "create_instance" in ops:
        ok = cut_lineage(_with_free_start_page(ok, work.files))
    tops = ok.where("op in ('delete', 'remove', 'move')").select(
        *TREE,
        F.col("source").alias("_top"),
        F.when(
            F.col("op") == "move",
            F.concat("parent", F.array(F.col("seq") + F.lit(APPENDED))),
        ).alias("_to"),
        F.col("op").alias("_op"),
    )
    below = work.nodes.select(
        *NODE, "topic", F.explode(P.prefixes(F.col("node_path"))).alias("_top")
    ).join(tops, [*TREE, "_top"])

    nodes, instances, files = work
    if ops & {*_STRUCTURE, *_LABEL, "create_instance", "delete_instance"}:
        nodes = cut_lineage(_apply_tree(work.nodes, ok, below, ops))
    if ops & {*_LABEL, *_SETTING, "create_instance", "delete_instance"}:
        instances = cut_lineage(_apply_settings(work, ok, ops))
    if ops & {*_LABEL, *_ADD, "delete", "delete_instance"}:
        files = cut_lineage(_apply_files(work, ok, below, ops))
    return Corpus(nodes, instances, files)


def _new_nodes(ok: DataFrame) -> DataFrame:
    about = F.when(F.col("op") == "create_instance", X.about_title(F.col("title")))
    return ok.where(F.col("op").isin(*_ADD)).select(
        *TREE,
        F.concat(
            F.coalesce("parent", F.array().cast("array<bigint>")), F.array(F.col("seq") + F.lit(APPENDED))
        ).alias("node_path"),
        F.col("new_file").alias("topic"),
        F.coalesce(about, "title").alias("title"),
        F.lit(None).cast("map<string,string>").alias("more"),
        "seq",
    )


def _apply_tree(nodes: DataFrame, ok: DataFrame, below: DataFrame, ops: set[str]) -> DataFrame:
    """Tree nodes after one round. ``below``: nodes under those taken away or moved."""
    path, topic, title = F.col("node_path"), F.col("topic"), F.col("title")
    if ops & {"delete", "remove"}:
        nodes = nodes.join(below.where("_op != 'move'").select(*NODE), NODE, "left_anti")
    if "delete_instance" in ops:
        nodes = nodes.join(ok.where("op = 'delete_instance'").select(*TREE), TREE, "left_anti")
    if "move" in ops:
        # Of nodes that move one below the other, each takes what is below it and not below the next.
        goal = F.concat("_to", F.slice("node_path", F.size("_top") + 1, F.size("node_path")))
        moved = below.where("_op = 'move'").groupBy(*NODE).agg(F.max_by(goal, F.size("_top")).alias("_path"))
        nodes, path = nodes.join(moved, NODE, "left"), F.coalesce("_path", "node_path")
    if ops & {*_LABEL}:
        labels = ok.where(F.col("op").isin(*_LABEL)).select(
            *TREE,
            F.col("source").alias("node_path"),
            F.col("new_file").alias("_topic"),
            F.col("title").alias("_title"),
        )
        nodes = nodes.join(labels, NODE, "left")
        topic, title = F.coalesce("_topic", "topic"), F.coalesce("_title", "title")
    nodes = nodes.select(*TREE, path.alias("node_path"), topic.alias("topic"), title.alias("title"), "more")
    if ops & {*_ADD}:
        nodes = nodes.unionByName(_new_nodes(ok).select(*NODE_COLUMNS))
    return nodes


def _with_free_start_page(ok: DataFrame, files: DataFrame) -> DataFrame:
    """Give a new instance's first topic a file name that is not taken."""
    wanted = ok.where("op = 'create_instance'").select("project_id", "seq", "title", "new_file")
    free = naming.free_start_pages(wanted, files).select("project_id", "seq", F.col("file").alias("_free"))
    return (
        ok.join(free, ["project_id", "seq"], "left")
        .withColumn("new_file", F.coalesce("_free", "new_file"))
        .drop("_free")
    )


def _apply_settings(work: Corpus, ok: DataFrame, ops: set[str]) -> DataFrame:
    """Instance rows after one round."""
    rows = work.instances.withColumn("ordinal", F.col("ordinal").cast("bigint"))
    if "delete_instance" in ops:
        rows = rows.join(ok.where("op = 'delete_instance'").select(*TREE), TREE, "left_anti")
    if ops & {*_LABEL, *_SETTING}:
        # Only a tree with a single root lets a rename move the start page.
        single = tree.root_counts(work.nodes).where("n_roots = 1").select(*TREE, F.lit(True).alias("single"))
        page = F.when(F.col("op") == "set_start", F.col("topic")).when(
            F.col("op").isin(*_LABEL) & F.col("single"), F.col("new_file")
        )
        changes = (
            ok.where(F.col("op").isin(*_LABEL, *_SETTING))
            .join(single, TREE, "left")
            .select(
                *TREE, "seq", page.alias("page"), F.when(F.col("op") == "rename_instance", F.col("title")).alias("new_name")
            )
            .groupBy(*TREE)
            .agg(
                F.max_by("page", F.when(F.col("page").isNotNull(), F.col("seq"))).alias("page"),
                F.max_by("new_name", F.when(F.col("new_name").isNotNull(), F.col("seq"))).alias("new_name"),
            )
        )
        rows = rows.join(changes, TREE, "left").select(
            *TREE,
            F.coalesce("new_name", "name").alias("name"),
            F.coalesce("page", "start_page").alias("start_page"),
            "ordinal",
        )
    if "create_instance" in ops:
        # seq orders the instances created in one round.
        rows = rows.unionByName(
            ok.where("op = 'create_instance'").select(
                *TREE,
                F.col("title").alias("name"),
                F.col("new_file").alias("start_page"),
                (F.col("seq") + F.lit(APPENDED)).alias("ordinal"),
            )
        )
    return rows


def _apply_files(work: Corpus, ok: DataFrame, below: DataFrame, ops: set[str]) -> DataFrame:
    """File names after one round; creations and deletions never meet in a round."""
    files = work.files
    if ops & {"delete", "delete_instance"}:
        of_instances = work.nodes.join(ok.where("op = 'delete_instance'").select(*TREE), TREE, "left_semi")
        dropped = below.where("_op = 'delete'").select("project_id", F.col("topic").alias("file"))
        if "delete_instance" in ops:
            dropped = dropped.unionByName(of_instances.select("project_id", F.col("topic").alias("file")))
        files = files.join(dropped, ["project_id", "file"], "left_anti")
    if ops & {*_LABEL}:
        heading = ok.where("op = 'edit_title'").select(
            "project_id", F.col("topic").alias("file"), F.col("heading").alias("_heading")
        )
        # A file is renamed only onto a free name, and by the first edit that asks for it.
        renames = (
            ok.where(F.col("op").isin(*_LABEL))
            .where("topic != new_file")
            .select("project_id", F.col("topic").alias("file"), F.col("new_file").alias("_new"), "seq")
            .join(work.files.select("project_id", "file"), ["project_id", "file"], "left_semi")
            .join(work.files.select("project_id", F.col("file").alias("_new")), ["project_id", "_new"], "left_anti")
            .groupBy("project_id", "_new")
            .agg(F.min_by("file", "seq").alias("file"))
        )
        files = (
            files.join(heading, ["project_id", "file"], "left")
            .join(renames, ["project_id", "file"], "left")
            .select(
                "project_id",
                F.coalesce("_new", "file").alias("file"),
                "origin",
                "stub_title",
                F.coalesce("_heading", "heading").alias("heading"),
            )
        )
    if ops & {*_ADD}:
        created = (
            _new_nodes(ok)
            .groupBy("project_id", F.col("topic").alias("file"))
            .agg(F.min_by("title", "seq").alias("stub_title"))
            .join(work.files.select("project_id", "file"), ["project_id", "file"], "left_anti")
            .select(
                "project_id",
                "file",
                F.lit(None).cast("string").alias("origin"),
                "stub_title",
                F.lit(None).cast("string").alias("heading"),
            )
        )
        files = files.unionByName(created)
    return files
