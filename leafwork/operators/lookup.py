"""Key lookups and joins between trees, topics and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.functions import paths as P
from leafwork.functions import text as X
from leafwork.operators.tree import NODE, TREE


def first_instance(instances: DataFrame) -> DataFrame:
    """One row per instance id: the first in configuration order."""
    others = [c for c in instances.columns if c not in TREE]
    return (
        instances.groupBy(*TREE)
        .agg(F.min_by(F.struct(*others), F.col("ordinal")).alias("_first"))
        .select(*TREE, "_first.*")
    )


def find_instances(wanted: DataFrame, instances: DataFrame) -> DataFrame:
    """Look up instances by id; ``found`` is false where there is none."""
    hit = first_instance(instances).withColumn("found", F.lit(True))
    return wanted.join(hit, TREE, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def first_match(nodes: DataFrame, order: str = "preorder") -> DataFrame:
    """First node per (instance, topic), in document order or level by level.

    ``order='level'`` searches a sibling list whole before descending.
    """
    path = F.col("node_path")
    if order == "preorder":
        best = F.min(path)
    elif order == "level":
        best = F.min_by(path, P.level_first_key(path))
    else:
        raise ValueError(f"unknown order: {order}")
    return nodes.groupBy(*TREE, "topic").agg(best.alias("node_path"))


def find_nodes(wanted: DataFrame, nodes: DataFrame, order: str = "preorder") -> DataFrame:
    """Add ``node_path`` of the first node with each wanted (instance, topic).

    Nodes are reduced to one per topic before the join, so a topic repeated many
    times costs no more than one that is not.
    """
    keys = wanted.select(*TREE, "topic").distinct()
    candidates = nodes.select(*NODE, "topic").join(keys, [*TREE, "topic"], "left_semi")
    return wanted.join(first_match(candidates, order), [*TREE, "topic"], "left")


def file_titles(topics: DataFrame) -> DataFrame:
    """(project_id, file, file_title) of the topics; contents stay in the scan stage.

    ``topics`` has ``content``, or the ``title`` taken from it already.
    """
    file = F.col("file")
    title = X.topic_title(F.col("content"), file) if "content" in topics.columns else F.coalesce("title", X.file_label(file))
    return topics.select("project_id", "file", title.alias("file_title"))


def with_titles(nodes: DataFrame, topics: DataFrame) -> DataFrame:
    """Set node titles from topic files.

    ``nodes`` carries ``dialect``. In the JSON dialect only roots with a topic
    take the file's title, other nodes keep their own; in the XML dialect every
    node does. A node without a file shows the fallback.
    """
    titled = nodes.join(
        file_titles(topics).withColumnRenamed("file", "topic"), ["project_id", "topic"], "left"
    )
    from_file = F.coalesce("file_title", X.file_label(F.col("topic")))
    takes_file = (F.col("dialect") == "X") | (
        (F.size("node_path") == 1) & (F.coalesce("topic", F.lit("")) != "")
    )
    return titled.withColumn(
        "title", F.when(takes_file, from_file).otherwise(F.col("title"))
    ).drop("file_title")


def existing(wanted: DataFrame, topics: DataFrame) -> DataFrame:
    """Rows whose (project_id, file) exists."""
    return wanted.join(topics.select("project_id", "file"), ["project_id", "file"], "left_semi")


def missing(wanted: DataFrame, topics: DataFrame) -> DataFrame:
    """Rows whose (project_id, file) does not exist."""
    return wanted.join(topics.select("project_id", "file"), ["project_id", "file"], "left_anti")


def unique_ids(wanted: DataFrame, instances: DataFrame) -> DataFrame:
    """Wanted instance ids that are not taken."""
    return wanted.join(instances.select(*TREE), TREE, "left_anti")


def locate_entries(wanted: DataFrame, registry: DataFrame, trees: DataFrame) -> DataFrame:
    """Position of the first registry entry whose tree file has the wanted id.

    ``registry``: project_id, ordinal, src; ``trees``: project_id, src,
    instance_id. Entries without a source or without a file are passed over.
    """
    named = registry.where("src != ''").join(
        trees.select("project_id", "src", "instance_id"), ["project_id", "src"]
    )
    hits = named.groupBy(*TREE).agg(F.min("ordinal").alias("ordinal"))
    return wanted.join(hits, TREE, "left")
