"""Set-wise operators over instances: create, rename, delete, upsert, list."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.functions import text as X
from leafwork.functions.paths import posix_join
from leafwork.operators import naming
from leafwork.operators.skew import split_row_number
from leafwork.operators.tree import TREE


def create(requests: DataFrame, instances: DataFrame, topics: DataFrame) -> DataFrame:
    """New instances with one root each: id, name, start page, root title, stub.

    ``requests``: project_id, instance_id, title, seq. Ids that are taken are left
    out; the start page's file gets a free name.
    """
    first = requests.groupBy(*TREE).agg(F.min_by(F.struct("title", "seq"), "seq").alias("r")).select(*TREE, "r.*")
    new = first.join(instances.select(*TREE), TREE, "left_anti")
    about = X.about_title(F.col("title"))
    return naming.free_start_pages(new, topics).select(
        *TREE,
        F.col("title").alias("name"),
        F.col("file").alias("start_page"),
        about.alias("root_title"),
        X.stub(about).alias("content"),
        "seq",
    )


def rename(instances: DataFrame, names: DataFrame) -> DataFrame:
    """Instances with the last name given. ``names``: project_id, instance_id, name, seq."""
    last = names.groupBy(*TREE).agg(F.max_by("name", "seq").alias("_name"))
    return instances.join(last, TREE, "left").withColumn("name", F.coalesce("_name", "name")).drop("_name")


def delete(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Instances, or nodes, without those of the deleted instances."""
    return rows.join(deleted.select(*TREE), TREE, "left_anti")


def files_of(nodes: DataFrame, deleted: DataFrame) -> DataFrame:
    """Topic files that go with deleted instances, shared ones included."""
    return (
        nodes.join(deleted.select(*TREE), TREE, "left_semi")
        .select("project_id", F.col("topic").alias("file"))
        .distinct()
    )


def upsert(instances: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace instances in place by id, or append them in the order they came.

    ``changes``: project_id, instance_id, name, start_page, seq; the last change
    of an id gives its values, the first its place.
    """
    last = changes.groupBy(*TREE).agg(
        F.max_by(F.struct("name", "start_page"), "seq").alias("v"), F.min("seq").alias("seq")
    )
    known = instances.join(last.select(*TREE, "v"), TREE, "left").select(
        *TREE,
        F.when(F.col("v").isNotNull(), F.col("v.name")).otherwise(F.col("name")).alias("name"),
        F.when(F.col("v").isNotNull(), F.col("v.start_page")).otherwise(F.col("start_page")).alias("start_page"),
        F.col("ordinal").cast("bigint").alias("ordinal"),
    )
    ends = instances.groupBy("project_id").agg(F.max("ordinal").alias("_end"))
    new = split_row_number(
        last.join(instances.select(*TREE), TREE, "left_anti"), ["project_id"], "seq", "_rank"
    ).join(ends, "project_id", "left")
    return known.unionByName(
        new.select(
            *TREE,
            F.col("v.name").alias("name"),
            F.col("v.start_page").alias("start_page"),
            (F.coalesce(F.col("_end"), F.lit(-1)) + F.col("_rank")).cast("bigint").alias("ordinal"),
        )
    )


def listing(instances: DataFrame) -> DataFrame:
    """(id, name) of the instances in configuration order."""
    return instances.select(*TREE, "name", "ordinal").orderBy("project_id", "ordinal")


class Remaining(NamedTuple):
    """What is left after instances are deleted, in both dialects."""

    instances: DataFrame
    nodes: DataFrame
    files: DataFrame
    registry: DataFrame
    trees: DataFrame


def delete_all(
    deleted: DataFrame, instances: DataFrame, nodes: DataFrame, files: DataFrame, registry: DataFrame, trees: DataFrame
) -> Remaining:
    """Take instances out with everything that is theirs.

    Their nodes and topic files go, and in the XML dialect their registry entry and tree
    file too. ``instances`` has tree_path (NULL in the JSON dialect); ``registry``:
    project_id, ordinal, src; ``trees``: path.
    """
    gone = instances.join(deleted.select(*TREE), TREE, "left_semi")
    paths = gone.where("tree_path is not null").select(F.col("tree_path").alias("path")).distinct()
    entries = registry.withColumn("path", posix_join(F.col("project_id"), F.col("src")))
    return Remaining(
        delete(instances, deleted),
        delete(nodes, deleted),
        files.join(files_of(nodes, deleted), ["project_id", "file"], "left_anti"),
        entries.join(paths, "path", "left_anti").drop("path"),
        trees.join(paths, "path", "left_anti"),
    )


def register(created: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry with an entry ``<id>.tree`` for each created instance, after the others.

    ``created``: project_id, instance_id, seq.
    """
    ends = registry.groupBy("project_id").agg(F.max("ordinal").alias("_end"))
    new = split_row_number(created.select(*TREE, "seq"), ["project_id"], "seq", "_rank").join(ends, "project_id", "left")
    return registry.select("project_id", F.col("ordinal").cast("bigint").alias("ordinal"), "src").unionByName(
        new.select(
            "project_id",
            (F.coalesce(F.col("_end"), F.lit(-1)) + F.col("_rank")).cast("bigint").alias("ordinal"),
            F.concat("instance_id", F.lit(".tree")).alias("src"),
        )
    )


def upsert_trees(nodes: DataFrame, changes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """The trees after :func:`upsert`: a changed instance has the nodes its last change brings.

    ``changes`` and ``new_nodes`` have the instance and ``seq``; nodes of earlier changes
    are passed over, and a change without nodes leaves an empty tree.
    """
    last = changes.groupBy(*TREE).agg(F.max("seq").alias("seq"))
    brought = new_nodes.join(last, [*TREE, "seq"], "left_semi").select(nodes.columns)
    return delete(nodes, last).unionByName(brought)
