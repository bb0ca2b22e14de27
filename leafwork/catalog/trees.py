"""Registered queries: tree flattening, lookups and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.catalog import inputs as I
from leafwork.functions import paths as P
from leafwork.operators import lookup, tree

KEY = ["project_id", "instance_id"]


def path_column() -> Column:
    return P.path_key(F.col("node_path")).alias("path")


def toc_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent pointers flattened to paths, in document order."""
    nodes = tree.from_parents(I.edges(spark, sf_dir))
    return tree.preorder(nodes).select(
        *KEY, path_column(), P.depth(F.col("node_path")).alias("depth"), "topic"
    )


TOC_FLATTEN = f"""
with recursive {I.sql_toc()}
select project_id, instance_id, path, depth, topic from toc order by 1, 2, 3
"""


def toc_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of every node whose document id is a multiple of five."""
    nodes = I.toc(spark, sf_dir)
    return tree.children(nodes, nodes.where("doc_id % 5 = 0")).select(*KEY, path_column(), "topic")


TOC_CHILDREN = f"""
with recursive {I.sql_toc()}
select c.project_id, c.instance_id, c.path, c.topic from toc c join toc p
  on p.project_id = c.project_id and p.instance_id = c.instance_id and p.path = c.parent_path
where p.doc_id % 5 = 0
"""


def toc_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtrees of the nodes whose document id is a multiple of seven."""
    nodes = I.toc(spark, sf_dir)
    return tree.subtree(nodes, nodes.where("doc_id % 7 = 0")).select(
        *KEY, P.path_key(F.col("top_path")).alias("top"), path_column(), "topic"
    )


TOC_SUBTREE = f"""
with recursive {I.sql_toc()}
select t.project_id, t.instance_id, a.path as top, t.path, t.topic from toc t join toc a
  on a.project_id = t.project_id and a.instance_id = t.instance_id and starts_with(t.path, a.path)
where a.doc_id % 7 = 0
"""


def toc_subtree_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of nodes in every node's subtree."""
    return tree.subtree_sizes(I.toc(spark, sf_dir)).select(*KEY, path_column(), "subtree_size")


TOC_SUBTREE_SIZE = f"""
with recursive {I.sql_toc()}, up as (
  select project_id, instance_id, unnest([path[1:(11 * i + 10)] for i in range(0, depth + 1)]) as path from toc)
select project_id, instance_id, path, count(*) as subtree_size from up group by all
"""


def toc_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent topic of every node, and the topmost ancestor the original lookup gives."""
    nodes = I.toc(spark, sf_dir).select(*KEY, "node_path", "topic")
    real = tree.parents(nodes).withColumnRenamed("up_topic", "parent_topic").drop("up_path")
    top = tree.parents(nodes, mode="reference").select(*KEY, "node_path", F.col("up_topic").alias("root_topic"))
    return real.join(top, [*KEY, "node_path"]).select(*KEY, path_column(), "topic", "parent_topic", "root_topic")


TOC_PARENT = f"""
with recursive {I.sql_toc()}
select t.project_id, t.instance_id, t.path, t.topic, p.topic as parent_topic, r.topic as root_topic
from toc t
left join toc p on p.project_id = t.project_id and p.instance_id = t.instance_id and p.path = t.parent_path
left join toc r on t.depth > 0 and r.project_id = t.project_id and r.instance_id = t.instance_id and r.path = t.path[1:10]
"""


def toc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots per instance, the only root's topic, and nodes that have children."""
    nodes = I.toc(spark, sf_dir)
    inner = tree.child_counts(nodes).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_inner"), F.sum("n_children").alias("n_below_roots")
    )
    return tree.root_counts(nodes).join(inner, KEY, "left")


TOC_COUNTS = f"""
with recursive {I.sql_toc()},
r as (select project_id, instance_id, count(*) as n_roots,
        case when count(*) = 1 then min(topic) end as only_root_topic
      from toc where depth = 0 group by all),
i as (select project_id, instance_id, count(distinct parent_path) as n_inner, count(*)::bigint as n_below_roots
      from toc where depth > 0 group by all)
select r.project_id, r.instance_id, n_roots, only_root_topic, n_inner, n_below_roots from r left join i using (project_id, instance_id)
"""


def toc_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First node of each repeated topic: in document order, and level by level."""
    nodes = I.toc(spark, sf_dir, topic="concat('doc-', doc_id % 50, '.md')")
    pre = lookup.first_match(nodes).withColumnRenamed("node_path", "pre")
    level = lookup.first_match(nodes, order="level").withColumnRenamed("node_path", "level")
    return pre.join(level, [*KEY, "topic"]).select(
        *KEY, "topic", P.path_key(F.col("pre")).alias("preorder_path"), P.path_key(F.col("level")).alias("level_path")
    )


# Level-first: at each list, 0 marks a match that ends there and 1 one further down.
TOC_FIRST_MATCH = f"""
with recursive {I.sql_toc("'doc-' || (doc_id % 50) || '.md'")}, keyed as (
  select *, array_to_string([case when i = depth then '0' else '1' end || path[(11 * i + 1):(11 * i + 10)]
    for i in range(0, depth + 1)], '.') as level_key from toc)
select project_id, instance_id, topic, min(path) as preorder_path, arg_min(path, level_key) as level_path
from keyed group by all
"""


def display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tree view shows for each node."""
    nodes = I.toc(spark, sf_dir)
    dirs = I.instances(spark, sf_dir).groupBy("project_id").agg(
        F.concat(F.lit("/docs/"), "project_id", F.lit("/topics")).alias("topics_dir")
    )
    rows = tree.display_rows(nodes, dirs)
    return rows.select(*KEY, path_column(), "topic", "title", "has_children", "file_path")


DISPLAY_ROWS = f"""
with recursive {I.sql_toc()}
select project_id, instance_id, path, topic, 'old ' || doc_id as title,
  exists (select 1 from toc c where c.project_id = t.project_id and c.instance_id = t.instance_id
          and c.parent_path = t.path) as has_children,
  '/docs/' || project_id || '/topics/' || topic as file_path
from toc t
"""


def missing_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree nodes without a topic file."""
    wanted = I.toc(spark, sf_dir).withColumnRenamed("topic", "file")
    return lookup.missing(wanted, I.topics(spark, sf_dir)).select(*KEY, path_column(), "file")


MISSING_TOPICS = f"""
with recursive {I.sql_toc()}, {I.sql_topics()}
select project_id, instance_id, path, topic as file from toc t
where not exists (select 1 from topics f where f.project_id = t.project_id and f.file = t.topic)
"""


def labelled_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents whose topic file exists."""
    wanted = I.table(spark, sf_dir, "labels").selectExpr(
        f"{I.PROJECT} as project_id", f"{I.TOPIC} as file", "quality"
    )
    return lookup.existing(wanted, I.topics(spark, sf_dir)).select("project_id", "file", "quality")


LABELLED_TOPICS = f"""
with {I.sql_topics()}, wanted as (
  select {I._SQL['project']} as project_id, {I._SQL['topic']} as file, quality from labels)
select project_id, file, quality from wanted w
where exists (select 1 from topics f where f.project_id = w.project_id and f.file = w.file)
"""

QUERIES = {
    "toc_flatten": (toc_flatten, TOC_FLATTEN),
    "toc_children": (toc_children, TOC_CHILDREN),
    "toc_subtree": (toc_subtree, TOC_SUBTREE),
    "toc_subtree_size": (toc_subtree_size, TOC_SUBTREE_SIZE),
    "toc_parent": (toc_parent, TOC_PARENT),
    "toc_counts": (toc_counts, TOC_COUNTS),
    "toc_first_match": (toc_first_match, TOC_FIRST_MATCH),
    "display_rows": (display_rows, DISPLAY_ROWS),
    "missing_topics": (missing_topics, MISSING_TOPICS),
    "labelled_topics": (labelled_topics, LABELLED_TOPICS),
}
