"""Projects, trees, topics and edits derived from the given tables.

The tables hold no documentation projects, so each query derives its input from
them by projection, and its SQL twin does the same. A third of all documents
forms one project with a single tree (``mono``); the others are spread over
projects of up to 400 nodes, two instances each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PROJECT = "case when doc_id % 3 = 0 then 'mono' else concat('p', doc_id div 600) end"
INSTANCE = "case doc_id % 3 when 0 then 'm' when 1 then 'a' else 'b' end"
RANK = "cast(case when doc_id % 3 = 0 then doc_id div 3 else (doc_id % 600) div 3 end as bigint)"
# Instance 'b' has a single root, the others have three.
ROOTS = "case when doc_id % 3 = 2 then 1 else 3 end"
DIALECT = "case when doc_id % 3 = 0 or (doc_id div 600) % 2 = 1 then 'X' else 'J' end"
TOPIC = "concat('doc-', doc_id, '.md')"
# Documents are stored as a topic file with a different kind of start.
CONTENT = (
    "case doc_id % 4 when 0 then concat('# ', text) when 1 then concat('\\n\\n  # ', text)"
    " when 2 then text else concat('## ', text) end"
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic files; documents whose id is a multiple of 11 have none."""
    return (
        documents(spark, sf_dir)
        .where("doc_id % 11 != 0")
        .selectExpr(f"{PROJECT} as project_id", f"{TOPIC} as file", f"{CONTENT} as content")
    )


def all_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files, without any missing."""
    return documents(spark, sf_dir).selectExpr(f"{PROJECT} as project_id", f"{TOPIC} as file", f"{CONTENT} as content")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees as parent pointers: one or three roots, then four children per node."""
    return documents(spark, sf_dir).selectExpr(
        f"{PROJECT} as project_id",
        f"{INSTANCE} as instance_id",
        f"{RANK} as node",
        f"case when {RANK} >= {ROOTS} then ({RANK} - {ROOTS}) div 4 end as parent",
        f"cast(case when {RANK} >= {ROOTS} then ({RANK} - {ROOTS}) % 4 else {RANK} end as int) as ordinal",
        "doc_id",
        f"{TOPIC} as topic",
        "cast(null as string) as title",
        f"{DIALECT} as dialect",
    )


# Positions on the way up, from the rank alone: no join is needed to derive the path.
_PATH = """
    transform(reverse(aggregate(sequence(1, 32), named_struct('k', {rank}, 'p', array_repeat(0, 0)),
      (s, i) -> if(s.k < 0, s, if(s.k < {roots},
        named_struct('k', cast(-1 as bigint), 'p', concat(s.p, array(cast(s.k as int)))),
        named_struct('k', (s.k - {roots}) div 4, 'p', concat(s.p, array(cast((s.k - {roots}) % 4 as int)))))),
      s -> s.p)), x -> x)
"""


def toc(spark: SparkSession, sf_dir: str, topic: str = TOPIC) -> DataFrame:
    """The same trees as ``toc_nodes`` rows."""
    return documents(spark, sf_dir).selectExpr(
        f"{PROJECT} as project_id",
        f"{INSTANCE} as instance_id",
        f"{_PATH.format(rank=RANK, roots=ROOTS)} as node_path",
        "doc_id",
        f"{topic} as topic",
        "concat('old ', doc_id) as title",
        f"{DIALECT} as dialect",
    )


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per tree; the start page is the second root."""
    return documents(spark, sf_dir).where(f"{RANK} = 1").selectExpr(
        f"{PROJECT} as project_id",
        f"{INSTANCE} as instance_id",
        f"concat('Guide ', {INSTANCE}) as name",
        f"{TOPIC} as start_page",
        "cast(null as string) as tree_path",
        "cast(doc_id % 3 as int) as ordinal",
    )


# SQL twins -----------------------------------------------------------------

_SQL = {
    "project": "case when doc_id % 3 = 0 then 'mono' else 'p' || (doc_id // 600) end",
    "instance": "case doc_id % 3 when 0 then 'm' when 1 then 'a' else 'b' end",
    "rank": "case when doc_id % 3 = 0 then doc_id // 3 else (doc_id % 600) // 3 end",
    "roots": "case when doc_id % 3 = 2 then 1 else 3 end",
    "dialect": "case when doc_id % 3 = 0 or (doc_id // 600) % 2 = 1 then 'X' else 'J' end",
    "topic": "'doc-' || doc_id || '.md'",
    "content": (
        "case doc_id % 4 when 0 then '# ' || text when 1 then chr(10) || chr(10) || '  # ' || text"
        " when 2 then text else '## ' || text end"
    ),
}


def sql_topics() -> str:
    return (
        f"topics as (select doc_id, {_SQL['project']} as project_id, {_SQL['topic']} as file,"
        f" {_SQL['content']} as content from documents where doc_id % 11 <> 0)"
    )


def sql_all_topics() -> str:
    return sql_topics().replace(" where doc_id % 11 <> 0", "")


def sql_toc(topic: str = _SQL["topic"]) -> str:
    """CTEs ``base`` and ``toc`` (with ``path`` as sortable text); needs ``with recursive``."""
    return f"""
      base as (select *, case when node >= roots then (node - roots) // 4 end as parent,
                 case when node >= roots then (node - roots) % 4 else node end as ordinal
               from (select doc_id, {_SQL['project']} as project_id, {_SQL['instance']} as instance_id,
                       {_SQL['rank']} as node, {_SQL['roots']} as roots, {topic} as topic, {_SQL['dialect']} as dialect
                     from documents)),
      toc as (select project_id, instance_id, node, parent, ordinal, doc_id, topic, dialect, 0 as depth,
                lpad(ordinal::varchar, 10, '0') as path, ''::varchar as parent_path
              from base where parent is null
              union all
              select b.project_id, b.instance_id, b.node, b.parent, b.ordinal, b.doc_id, b.topic, b.dialect,
                t.depth + 1, t.path || '.' || lpad(b.ordinal::varchar, 10, '0'), t.path
              from toc t join base b on b.project_id = t.project_id and b.instance_id = t.instance_id
                and b.parent = t.node)"""


def sql_title(content: str, file: str) -> str:
    """Topic title in RE2; the inputs hold ASCII white space only."""
    head = rf"regexp_extract({content}, '\A\s*# ([^\n]*)', 1)"
    return f"coalesce(nullif(trim({head}, ' ' || chr(9) || chr(13)), ''), '<' || {file} || '>')"
