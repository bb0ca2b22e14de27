"""Operators over ``toc_nodes``: flattening, order, children, subtrees, parents, counts.

A node is identified by ``(project_id, instance_id, node_path)``; the path is the
array of sibling positions from the root down, so sorting by it is document
order, and a subtree is the set of nodes that have the path as a prefix. Prefix
tests are always turned into equi-joins by listing each node's prefixes (one row
per level), never into range or cross joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.functions import paths as P
from leafwork.operators.skew import split_row_number
from leafwork.session import cut_lineage

TREE = ["project_id", "instance_id"]
NODE = [*TREE, "node_path"]


def from_parents(edges: DataFrame) -> DataFrame:
    """Give every node reachable from a root its ``node_path``.

    ``edges``: project_id, instance_id, node, parent (NULL for roots), ordinal, and any
    further columns. Each node knows the way from some node above it; joining that
    node's own way doubles it, so the rounds are the logarithm of the depth, and only
    nodes that have not reached their root take part. Nodes below a missing parent or on
    a cycle are unreachable and left out.
    """
    state = cut_lineage(
        edges.select(*TREE, "node", F.col("parent").alias("_above"), F.array(F.col("ordinal").cast("int")).alias("node_path"))
    )
    # Depths have no gaps: after a round that brings no node to its root, only nodes on or
    # below a cycle (or a missing parent) are left.
    arrived = -1
    while True:
        now, left = state.agg(F.count_if(F.col("_above").isNull()), F.count_if(F.col("_above").isNotNull())).first()
        if now == arrived or not left:
            break
        open_ = state.where("_above is not null")
        up = state.select(*TREE, F.col("node").alias("_above"), F.col("_above").alias("_next"), F.col("node_path").alias("_way"))
        longer = open_.join(up, [*TREE, "_above"]).select(
            *TREE, "node", F.col("_next").alias("_above"), F.concat("_way", "node_path").alias("node_path")
        )
        state, arrived = cut_lineage(state.where("_above is null").unionByName(longer)), now
    walked = state.where("_above is null").select(*TREE, "node", "node_path")
    return edges.join(walked, [*TREE, "node"])


def preorder(nodes: DataFrame) -> DataFrame:
    """Nodes in document order, duplicates kept."""
    return nodes.orderBy(*NODE)


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.size("node_path") == 1)


def children(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Direct children of the given nodes (``parents`` has the node key columns)."""
    keys = parents.select(*TREE, F.col("node_path").alias("parent_path")).distinct()
    return nodes.withColumn("parent_path", P.parent_of(F.col("node_path"))).join(
        keys, [*TREE, "parent_path"], "left_semi"
    )


def subtree(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """All nodes below the given ones, those included, tagged with ``top_path``.

    ``tops`` has the node key columns. A node below several tops appears once
    for each of them.
    """
    keys = tops.select(*TREE, F.col("node_path").alias("top_path")).distinct()
    return nodes.withColumn("top_path", F.explode(P.prefixes(F.col("node_path")))).join(
        keys, [*TREE, "top_path"]
    )


def outside(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes that lie in none of the given subtrees."""
    inside = subtree(nodes.select(*NODE), tops).select(*NODE).distinct()
    return nodes.join(inside, NODE, "left_anti")


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """Number of nodes in each node's subtree (combined before the shuffle)."""
    per_prefix = nodes.select(*TREE, F.explode(P.prefixes(F.col("node_path"))).alias("node_path"))
    return per_prefix.groupBy(*NODE).agg(F.count(F.lit(1)).alias("subtree_size"))


def child_counts(nodes: DataFrame) -> DataFrame:
    """Number of children per node that has any."""
    below = nodes.where(F.size("node_path") > 1)
    return below.groupBy(*TREE, P.parent_of(F.col("node_path")).alias("node_path")).agg(
        F.count(F.lit(1)).alias("n_children")
    )


def root_counts(nodes: DataFrame) -> DataFrame:
    """Number of roots per instance, and the root's topic where there is only one."""
    return roots(nodes).groupBy(*TREE).agg(
        F.count(F.lit(1)).alias("n_roots"), F.min("topic").alias("any_root_topic")
    ).select(*TREE, "n_roots", F.when(F.col("n_roots") == 1, F.col("any_root_topic")).alias("only_root_topic"))


def parents(nodes: DataFrame, mode: str = "corrected") -> DataFrame:
    """Each node with its parent's path and topic (NULL for a root).

    ``mode='reference'`` gives the ancestor at depth 0 instead, for nodes at
    every depth: the behaviour to choose when results must equal those of the
    original lookup.
    """
    up = P.root_of if mode == "reference" else P.parent_of
    lookup = nodes.select(*TREE, F.col("node_path").alias("up_path"), F.col("topic").alias("up_topic"))
    with_up = nodes.withColumn(
        "up_path", F.when(F.size("node_path") > 1, up(F.col("node_path")))
    )
    # Roots have no partner; keeping them out of the join keeps their NULL key
    # from gathering in one partition.
    below = with_up.where("up_path is not null").join(lookup, [*TREE, "up_path"], "left")
    tops = with_up.where("up_path is null").withColumn("up_topic", F.lit(None).cast("string"))
    return below.unionByName(tops)


def display_rows(nodes: DataFrame, topics_dir: DataFrame) -> DataFrame:
    """Title, topic, has-children flag and file path of each node.

    ``topics_dir``: project_id, topics_dir.
    """
    counted = nodes.join(child_counts(nodes), NODE, "left")
    return counted.join(topics_dir.select("project_id", "topics_dir"), "project_id", "left").select(
        *NODE,
        "topic",
        "title",
        F.col("n_children").isNotNull().alias("has_children"),
        P.posix_join(F.col("topics_dir"), F.col("topic")).alias("file_path"),
    )


def renumber(nodes: DataFrame) -> DataFrame:
    """Close the gaps in sibling positions, keeping their order.

    Positions are counted per sibling list in slices; only nodes whose position
    changes, and the nodes below them, are touched by the second step.
    """
    path = F.col("node_path")
    siblings = nodes.select(*NODE, P.parent_of(path).alias("_list"), P.ordinal_of(path).alias("_at"))
    ranked = split_row_number(siblings, [*TREE, "_list"], "_at", "_rank")
    moved = ranked.where("_rank - 1 != _at").select(
        *TREE, F.col("node_path").alias("_prefix"), (F.col("_rank") - 1).cast("int").alias("_new")
    )
    hits = (
        nodes.select(*NODE, F.explode(P.prefixes(path)).alias("_prefix"))
        .join(moved, [*TREE, "_prefix"])
        .groupBy(*NODE)
        # One entry per level at most.
        .agg(F.map_from_entries(F.collect_list(F.struct(F.size("_prefix"), "_new"))).alias("_fix"))
    )
    fixed = F.transform(
        path, lambda x, i: F.coalesce(F.element_at(F.col("_fix"), i + 1), x)
    )
    return (
        nodes.join(hits, NODE, "left")
        .withColumn("node_path", F.when(F.col("_fix").isNull(), path).otherwise(fixed))
        .drop("_fix")
    )
