"""Registered queries: corpora of files, written from the given tables and read back.

Twenty documents make a project; even projects have a JSON configuration, odd ones a
module file with one tree file. Trees and modules name the files that are found in the
folders, so they are written after these.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.catalog import inputs as I
from leafwork.functions import text as X
from leafwork.plans.open_projects import open_projects
from leafwork.session import cut_lineage, scratch_folder, small_files
from leafwork.sinks.named_files import write_files
from leafwork.sources import files, json_config, xml_config

_PROJECT = "concat('p', doc_id div 20)"
_AT_ONCE = 50_000  # topics, about, whose addresses the driver holds at a time where Spark lists them


def _write(rows: DataFrame, folder: str, *parts: str) -> None:
    """One file for each row, at the path that ``parts`` make, columns or texts."""
    # A project without a name has the folder that Spark gives it.
    steps = [F.coalesce(F.col(p), F.lit("__HIVE_DEFAULT_PARTITION__")) if p in rows.columns else F.lit(p) for p in parts]
    write_files(rows.select(F.concat(F.lit("project="), F.concat_ws("/", *steps)).alias("path"), "content"), folder)


def _globs(docs: DataFrame, folder: str) -> list[str]:
    """Globs that have each project's topics folder once: by how the projects' names end."""
    n, k = docs.count(), 0
    while _AT_ONCE * 10**k < n:
        k += 1
    if not k:
        return [f"{folder}/project=*/docs=md"]
    ends = docs.selectExpr(f"coalesce(right(project, {k}), '__') as e").distinct().collect()
    return sorted(f"{folder}/project=*{r['e']}/docs=md" for r in ends)


def _written(spark: SparkSession, sf_dir: str) -> tuple[str, list[str]]:
    """The folder of a corpus, and globs of its topics: ``project=…/docs=md/`` for topics, ``project=…/`` for
    configurations, ``project=…/tree=t/`` for tree files. Every fourth topic is in no tree."""
    folder = f"{scratch_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = I.documents(spark, sf_dir).selectExpr(f"{_PROJECT} as project", f"{I.TOPIC} as file", f"{I.CONTENT} as content")
    _write(docs, folder, "project", "docs=md", "file")
    whole = f"{folder}/project=*/docs=md"
    globs = [whole] if files.in_tasks(spark, whole) else _globs(docs, folder)

    def listing(glob: str) -> DataFrame:
        topics = files.list_files(spark, glob).select(
            F.regexp_extract("path", r"/project=([^/]*)/", 1).alias("project"),
            F.regexp_extract("path", r"/docs=md/(.*)\z", 1).alias("topic"),
            F.regexp_extract("path", r"doc-([0-9]+)[.]md\z", 1).cast("long").alias("doc_id"),
        ).where("doc_id % 4 != 3")
        return topics.groupBy("project").agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "topic"))), lambda t: t["topic"]).alias("topics"))

    listed = reduce(DataFrame.unionByName, [cut_lineage(listing(glob)) for glob in globs])
    even = F.expr("substr(project, 2) % 2 = 0")
    nodes = F.transform("topics", lambda t: F.struct(t.alias("topic")))
    config = F.struct(
        F.struct(F.lit("docs=md").alias("dir")).alias("topics"),
        F.array(F.struct(F.col("project").alias("id"), F.lit("n").alias("name"), nodes.alias("toc-elements"))).alias("instances"),
    )
    _write(listed.where(even).select("project", F.to_json(config).alias("content")), folder, "project", "config.txt")
    elements = F.array_join(F.transform("topics", lambda t: F.concat(F.lit('<toc-element topic="'), t, F.lit('"/>'))), "")
    profile = F.concat(F.lit('<instance-profile id="'), "project", F.lit('">'), elements, F.lit("</instance-profile>"))
    _write(listed.where(~even).select("project", profile.alias("content")), folder, "project", "tree=t", "tree.txt")
    src = files.list_files(spark, f"{folder}/project=*/tree=t").select(
        F.regexp_extract("path", r"/project=([^/]*)/", 1).alias("project"), F.regexp_extract("path", r"/(tree=t/.*)\z", 1).alias("src")
    )
    module = F.concat(F.lit('<ihp version="2.0"><topics dir="docs=md"/><instance src="'), "src", F.lit('"/></ihp>'))
    _write(src.select("project", module.alias("content")), folder, "project", "module.txt")
    return folder, globs


def _configs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """JSON and module configurations: both lie in the project's folder here."""
    every = cut_lineage(files.read_json_configs(spark, f"{folder}/project=*/*.txt"))
    return every.where("content like '{%'"), every.where("content like '<%'")


def files_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus written as files, read back and opened: every node with its title."""
    with small_files(spark):
        folder, globs = _written(spark, sf_dir)
        json_side, xml_side = _configs(spark, folder)
        trees = cut_lineage(files.read_tree_files(spark, f"{folder}/project=*/tree=t"))
        folders = cut_lineage(json_config.projects(json_side).unionByName(xml_config.projects(xml_side)))
        title = X.heading(F.col("content")).alias("title")
        titles = reduce(DataFrame.unionByName, [cut_lineage(files.read_topics(spark, glob, folders).select("project_id", "file", title)) for glob in globs])
        opened = open_projects(json_side.select("project_id", "content"), xml_side.select("project_id", "content"), trees, titles)
        return cut_lineage(opened.nodes.select(
            F.regexp_extract("project_id", r"project=([^/]*)\z", 1).alias("project_id"), "instance_id", "dialect",
            F.col("node_path")[0].alias("ordinal"), F.col("topic").alias("file"),
            F.regexp_replace("title", r"\A<.*>\z", "-").alias("title"),
        ))


FILES_ROUNDTRIP = f"""
select 'p' || (doc_id // 20) as project_id, 'p' || (doc_id // 20) as instance_id,
  case when doc_id // 20 % 2 = 0 then 'J' else 'X' end as dialect,
  row_number() over (partition by doc_id // 20 order by doc_id)::int - 1 as ordinal, {I._SQL['topic']} as file,
  regexp_replace({I.sql_title(I._SQL['content'], "'~'")}, '\\A<.*>\\z', '-') as title
from documents where doc_id % 4 <> 3
"""


def pruned_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the topics that the JSON projects' trees name; other files are not opened."""
    with small_files(spark):
        folder, globs = _written(spark, sf_dir)
        json_side, _ = _configs(spark, folder)
        named = cut_lineage(json_config.nodes(json_side).select("project_id", F.col("topic").alias("file")))
        folders = cut_lineage(json_config.projects(json_side))
        titles = reduce(DataFrame.unionByName, [cut_lineage(files.read_titles(spark, glob, folders, named)) for glob in globs])
        return titles.select(F.regexp_extract("project_id", r"project=([^/]*)\z", 1).alias("project_id"), "file", "title")


PRUNED_TITLES = f"""
select project_id, file, nullif(title, '<~>') as title from (
  select 'p' || (doc_id // 20) as project_id, {I._SQL['topic']} as file, {I.sql_title(I._SQL['content'], "'~'")} as title
  from documents where doc_id % 4 <> 3 and doc_id // 20 % 2 = 0)
"""

QUERIES = {
    "files_roundtrip": (files_roundtrip, FILES_ROUNDTRIP),
    "pruned_titles": (pruned_titles, PRUNED_TITLES),
}
