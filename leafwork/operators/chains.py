"""Edits that follow each other on one node, taken together.

A rename of what an earlier rename made (a to b, then b to c) has to wait for it, and so
has a move of what was just moved; a session of a hundred such steps would be a hundred
rounds. Here chains of renames become one rename each, by doubling their links, and runs
of moves share a unit, within which a round finds what each step does to the next.

Two renames are linked only if nobody could tell the difference: the name between them is
used by these two edits alone, and neither it nor the last name is taken or used before;
no new instance comes before them, which might take such a name; no edit of the tree, or
deletion in the project, lies between them that may take nodes or files away, change the
roots or the start page.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions import text as X
from leafwork.operators.skew import split_lag, split_running_max
from leafwork.operators.tree import TREE
from leafwork.session import cut_lineage

LABEL = ("rename", "edit_title")
_NAMED = (*LABEL, "add_root", "add_child", "add_sibling")
# What no chain may pass, in its tree and in its project.
_TREE_WALLS = ("delete", "remove", "add_root", "add_sibling", "move", "set_start", "create_instance", "delete_instance")
_PROJECT_WALLS = ("delete", "delete_instance")
# What ends a run of moves of one topic.
_TREE_STEPS = ("delete", "remove", "add_root", "add_child", "add_sibling", "move", *LABEL, "create_instance", "delete_instance")


class Chained(NamedTuple):
    pending: DataFrame
    """The edits with one for each chain, ``heading`` and ``unit``."""
    members: DataFrame | None
    """(project_id, seq, unit) of all edits that chains replace; ``unit`` is the chain's seq."""
    runs: bool
    """Whether there are units of several moves."""


def new_name() -> Column:
    """The file that an edit brings into its tree."""
    made = F.when(F.col("op") == "create_instance", X.start_page_file(F.col("title")))
    return made.when(F.col("op").isin(*_NAMED), F.coalesce("file_name", X.slug(F.col("title"))))


def chained(pending: DataFrame, nodes: DataFrame, files: DataFrame) -> Chained:
    """``pending``: project_id, instance_id, seq, op, topic, target, title, file_name."""
    pending = pending.withColumn("heading", F.when(F.col("op") == "edit_title", F.col("title")))
    links = _links(pending, nodes, files)
    members = None
    if links is not None:
        members = _heads(links)
        pending = cut_lineage(_merged(pending, members))
    runs = not pending.where("op = 'move'").groupBy(*TREE, "topic").count().where("count > 1").isEmpty()
    return Chained(_with_units(pending) if runs else pending.withColumn("unit", F.col("seq")), members, runs)


def _links(pending: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame | None:
    """(project_id, instance_id, seq, then): each rename with the one that goes on from it; None if there is none."""
    named = pending.withColumn("new", new_name())
    uses = named.select("project_id", "seq", F.explode(F.array_distinct(F.array("topic", "target", "new"))).alias("name")).where("name is not null")
    counted = uses.groupBy("project_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"), F.max("seq").alias("then"))
    labels = named.where(F.col("op").isin(*LABEL)).select(*TREE, "seq", "topic", "new")
    one = labels.where("topic != new").select(*TREE, "seq", F.col("new").alias("name"))
    two = labels.where("topic != new").select(*TREE, F.col("seq").alias("then"), F.col("topic").alias("name"), F.col("new").alias("last"))
    between = counted.where("n = 2").drop("n").join(one, ["project_id", "seq", "name"]).join(two, [*TREE, "then", "name"])
    if between.isEmpty():
        return None
    first = counted.select("project_id", F.col("name").alias("last"), F.col("seq").alias("then"))
    taken = files.select("project_id", F.col("file").alias("name")).unionByName(nodes.select("project_id", F.col("topic").alias("name"))).distinct()
    links = between.join(first, ["project_id", "last", "then"]).join(taken, ["project_id", "name"], "left_anti")
    links = cut_lineage(links.join(taken.withColumnRenamed("name", "last"), ["project_id", "last"], "left_anti").select(*TREE, "seq", "then"))
    made = pending.where("op = 'create_instance'").groupBy("project_id").agg(F.min("seq").alias("_made"))
    links = links.join(made, "project_id", "left").where("_made is null or then < _made").drop("_made")
    for keys, walls in ((TREE, _TREE_WALLS), (["project_id"], _PROJECT_WALLS)):
        links = _without_walls(links, pending.where(F.col("op").isin(*walls)), keys)
    return None if links.isEmpty() else links


def _without_walls(links: DataFrame, walls: DataFrame, keys: list[str]) -> DataFrame:
    """The links with no wall between their edits."""
    if walls.isEmpty():
        return links
    marks = links.select(*TREE, "seq", "then", F.col("then").alias("_at"), F.lit(None).cast("bigint").alias("_wall"))
    rows = marks.unionByName(walls.select(*TREE, F.col("seq").alias("_at"), F.col("seq").alias("_wall")), allowMissingColumns=True)
    passed = split_running_max(rows, keys, ["_at"], "_wall", "_last")
    return cut_lineage(passed.where("then is not null and (_last is null or _last < seq)").select(*TREE, "seq", "then"))


def _heads(links: DataFrame) -> DataFrame:
    """(project_id, seq, unit): every edit of a chain, with the chain's first.

    Each edit knows one before it; taking that one's own doubles the way, so the steps are
    the logarithm of the longest chain.
    """
    state = cut_lineage(links.select("project_id", F.col("then").alias("seq"), F.col("seq").alias("unit")))
    while True:
        further = state.select("project_id", F.col("seq").alias("unit"), F.col("unit").alias("_further"))
        state = cut_lineage(state.join(further, ["project_id", "unit"], "left"))
        if state.where("_further is not null").isEmpty():
            break
        state = state.select("project_id", "seq", F.coalesce("_further", "unit").alias("unit"))
    found = state.select("project_id", "seq", "unit")
    return cut_lineage(found.unionByName(found.select("project_id", F.col("unit").alias("seq"), "unit").distinct()))


def _merged(pending: DataFrame, members: DataFrame) -> DataFrame:
    """The edits, with each chain as one rename from its first name to its last."""
    rows = pending.withColumn("new", new_name()).join(members, ["project_id", "seq"])
    whole = rows.groupBy("project_id", F.col("unit").alias("_unit")).agg(
        F.first("instance_id").alias("instance_id"),
        F.max("op").alias("_op"),
        F.min("op").alias("op"),  # edit_title, if there is one
        F.min_by("topic", "seq").alias("topic"),
        F.max_by("title", "seq").alias("title"),
        F.max_by("new", "seq").alias("file_name"),
        F.max_by("heading", F.when(F.col("heading").isNotNull(), F.col("seq"))).alias("heading"),
    )
    one = whole.withColumnRenamed("_unit", "seq").withColumn("target", F.lit(None).cast("string"))
    return pending.join(members, ["project_id", "seq"], "left_anti").unionByName(one.select(*pending.columns))


def _with_units(pending: DataFrame) -> DataFrame:
    """Adds ``unit``: the first of a run of moves of one topic, else the edit itself."""
    steps = pending.where(F.col("op").isin(*_TREE_STEPS)).select(*TREE, "seq", "op", "topic")
    before = split_lag(steps, TREE, ["seq"], {"_op": "op", "_topic": "topic"})
    goes_on = (F.col("op") == "move") & (F.col("_op") == "move") & (F.col("topic") == F.col("_topic"))
    started = before.withColumn("_start", F.when(F.coalesce(goes_on, F.lit(False)), None).otherwise(F.col("seq")))
    units = split_running_max(started, TREE, ["seq"], "_start", "unit").where("seq != unit").select(*TREE, "seq", "unit")
    return cut_lineage(pending.join(units, [*TREE, "seq"], "left").withColumn("unit", F.coalesce("unit", "seq")))


def settled_moves(ready: DataFrame) -> DataFrame:
    """The edits of a round with the status of moves that follow others, and ``last``:
    false for a move that a later one of its unit replaces."""
    valid = ready.where("op = 'move' and status in ('applied', 'already there')")
    before = split_lag(valid.select("project_id", "unit", "seq", "source", "parent"), ["project_id", "unit"], ["seq"], {"_before": "parent"})
    came = F.coalesce("_before", F.slice("source", F.lit(1), F.size("source") - 1))
    told = before.select("project_id", "unit", "seq", F.when(came == F.col("parent"), "already there").otherwise("applied").alias("_status"))
    last = told.where("_status = 'applied'").groupBy("project_id", "unit").agg(F.max("seq").alias("_last"))
    return (
        ready.join(told.select("project_id", "seq", "_status"), ["project_id", "seq"], "left")
        .join(last, ["project_id", "unit"], "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .withColumn("last", F.coalesce(F.col("op") != "move", F.lit(True)) | (F.col("seq") == F.col("_last")))
        .drop("_status", "_last")
    )
