"""Registered queries: changes in time, as batches and as streams, and opening projects."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.catalog import configs as C
from leafwork.catalog import inputs as I
from leafwork.functions import paths as P
from leafwork.plans.open_projects import Opened, open_projects
from leafwork.session import scratch_folder
from leafwork.streaming import changes as S

EVENT = ["event_id", "ts", "user_id", "event_type"]
# Clicks are saves without a heading, errors are blank files.
_SAVE = "case event_type when 'click' then 'text' when 'error' then ' \\n' else concat('\\n# ', event_type, ' \\nbody') end"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "events").select(*EVENT)


def _either(sf_dir: str, name: str) -> str:
    """A pattern for a table, since a stream's plain path must be a folder, not a file."""
    return f"{sf_dir}/{name}.parque[t]"


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = I.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(_either(sf_dir, "events")).select(*EVENT)


def _as_changes(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "concat('u', user_id % 7) as project_id", "concat('f', user_id, '.cfg') as path",
        "case event_type when 'error' then 'delete' when 'signup' then 'create' else 'change' end as kind",
        "ts", "event_id as seq", "concat('v', event_id) as content",
    )


def _as_saves(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "concat('u', user_id % 7) as project_id", "concat('f', user_id, '.md') as file",
        "ts", "event_id as seq", f"{_SAVE} as content",
    )


def _as_opened(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "concat('s', user_id % 7) as session", "concat('f', user_id % 5, '.md') as file",
        "ts", "event_id as seq", "if(event_type = 'click', '## no', concat('#', event_type)) as content",
    )


def change_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last change of every file, deletions as tombstones."""
    return S.latest_changes(_as_changes(_events(spark, sf_dir)))


def change_latest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, followed as a stream."""
    folder = f"{scratch_folder(spark)}/{uuid.uuid4()}"
    S.follow_changes(_as_changes(_event_stream(spark, sf_dir)), folder).awaitTermination()
    return S.latest_state(spark, folder)


CHANGE_LATEST = """
with c as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events)
select 'u' || (user_id % 7) as project_id, 'f' || user_id || '.cfg' as path,
  case event_type when 'error' then 'delete' when 'signup' then 'create' else 'change' end as kind,
  'v' || event_id as content, ts, event_id as seq, event_type <> 'error' as exists
from c where rn = 1
"""


def title_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saves that change a file's title."""
    return S.title_changes(_as_saves(_events(spark, sf_dir)))


def title_changes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, followed as a stream."""
    folder = f"{scratch_folder(spark)}/{uuid.uuid4()}"
    S.follow_titles(_as_saves(_event_stream(spark, sf_dir)), folder, delay="0 seconds").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


TITLE_CHANGES = """
with s as (select user_id, ts, event_id, case when event_type = 'click' then '' else event_type end as title
           from events where event_type <> 'error'),
l as (select *, lag(title) over (partition by user_id order by ts, event_id) as before from s)
select 'u' || (user_id % 7) as project_id, 'f' || user_id || '.md' as file, ts, event_id as seq, title
from l where before is null or before <> title
"""


def title_rename_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rename edits for the changed titles of files that a tree holds."""
    changed = S.title_changes(_as_saves(_events(spark, sf_dir)))
    nodes = I.documents(spark, sf_dir).selectExpr(
        "concat('u', doc_id % 7) as project_id", "source as instance_id", "concat('f', doc_id, '.md') as topic"
    )
    return S.rename_edits(changed, nodes).select("project_id", "instance_id", "seq", "op", "topic", "title")


TITLE_RENAME_EDITS = f"""
with c as ({TITLE_CHANGES})
select c.project_id, d.source as instance_id, c.seq, 'rename' as op, c.file as topic, c.title
from c join documents d on 'f' || d.doc_id || '.md' = c.file and 'u' || (d.doc_id % 7) = c.project_id
where c.title <> ''
"""


def current_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of sessions from one file to another."""
    return S.current_topics(_as_opened(_events(spark, sf_dir)))


def current_topics_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, followed as a stream."""
    folder = f"{scratch_folder(spark)}/{uuid.uuid4()}"
    S.follow_sessions(_as_opened(_event_stream(spark, sf_dir)), folder, delay="0 seconds").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


CURRENT_TOPICS = """
with s as (select 's' || (user_id % 7) as session, 'f' || (user_id % 5) || '.md' as file, ts, event_id, event_type
           from events where event_type <> 'click'),
l as (select *, lag(file) over (partition by session order by ts, event_id) as before from s)
select session, file, ts, event_id as seq, event_type as title from l where before is null or before <> file
"""


def _opened(spark: SparkSession, sf_dir: str) -> Opened:
    json_side = C.json_configs(spark, sf_dir).where("doc_id % 2 = 0").selectExpr(
        "concat('/w/', project_id) as project_id", "content"
    )
    xml_side = C.saved_modules(spark, sf_dir).where("doc_id % 3 != 0").select("project_id", "content")
    return open_projects(json_side, xml_side, C.tree_files(spark, sf_dir), _opened_topics(spark, sf_dir))


def opened_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project opened from its files: detection, validation, trees and titles."""
    return _opened_rows(_opened(spark, sf_dir))


def refused_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project that is refused when opened, with each error of its configurations, if any."""
    opened = _opened(spark, sf_dir)
    refused = opened.projects.where("config_code = 0").select("project_id", "config_code")
    return refused.join(opened.violations, "project_id", "left")


def _opened_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.documents(spark, sf_dir).selectExpr(
        "concat('/w/d', doc_id) as project_id", "explode(array('l0.md', 'l1.md', 'l0-0.md')) as file",
        f"{I.CONTENT} as content",
    )


def _opened_rows(opened: Opened) -> DataFrame:
    return opened.nodes.select(
        "project_id", "instance_id", "dialect", P.path_key(F.col("node_path")).alias("path"), "topic", "title"
    )


OPENED_PROJECTS = f"""
with {C.SQL_LINES},
bad as (
  select doc_id from documents where doc_id % 7 <= 1 or doc_id % 5 = 0 or doc_id % 6 = 0
  union select doc_id from lines where length(line) % 3 = 0
  union select doc_id from sents where length(s) % 4 = 0),
coded as (
  select doc_id, text, source, case
    when doc_id % 2 = 0 and doc_id % 13 <> 0 then case when doc_id in (select doc_id from bad) then null else 'J' end
    when doc_id % 3 <> 0 and doc_id % 17 > 2 then 'X' end as dialect from documents),
heads as (select doc_id, dialect, source, {I.sql_title(I._SQL['content'], "'~'")} as head from coded),
j as (
  select doc_id, lang as instance_id, lpad(i::varchar, 10, '0') as path, 'l' || i || '.md' as topic, line as title, true as top from lines
  union all
  select doc_id, lang, lpad(i::varchar, 10, '0') || '.' || lpad(j::varchar, 10, '0'), 'l' || i || '-' || j || '.md', s, false from sents),
x as (
  select doc_id, '00' || doc_id as instance_id, path, topic from j where doc_id % 4 >= 1 and doc_id % 5 <> 0
  union all select doc_id, 'second', '0000000000', 'only.md' from documents where doc_id % 4 >= 2 and doc_id % 7 <> 0),
n as (
  select h.*, j.instance_id, j.path, j.topic, case when j.top then null else j.title end as own from heads h join j using (doc_id) where dialect = 'J'
  union all
  select h.*, x.instance_id, x.path, x.topic, null from heads h join x using (doc_id) where dialect = 'X')
select '/w/d' || doc_id as project_id, instance_id, dialect, path, topic,
  coalesce(own, case when topic in ('l0.md', 'l1.md', 'l0-0.md') and head <> '<~>' then head else '<' || topic || '>' end) as title
from n
"""

REFUSED_PROJECTS = f"""
with j_errors as (select '/w/' || project_id as project_id, instance_path, keyword, detail, 'J' as dialect from ({C.CONFIG_VIOLATIONS}) v
  where substr(project_id, 2)::bigint % 2 = 0),
x_errors as (select '/w/d' || doc_id as project_id, '' as instance_path, 'parse' as keyword, 'unreadable' as detail, 'X' as dialect
  from documents where doc_id % 3 <> 0 and doc_id % 17 <= 2),
codes as (
  select '/w/d' || doc_id as project_id, 0 as config_code from documents where (doc_id % 2 = 0 or doc_id % 3 <> 0) and case
    when doc_id % 2 = 0 and doc_id % 13 <> 0 then '/w/d' || doc_id in (select project_id from j_errors)
    else doc_id % 3 = 0 or doc_id % 17 <= 2 end)
select project_id, config_code, instance_path, keyword, detail, dialect
from codes left join (select * from j_errors union all select * from x_errors) errors using (project_id)
"""


def reload_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects opened again as their JSON configuration is saved or deleted, and only those."""
    folder = f"{scratch_folder(spark)}/{uuid.uuid4()}"
    schema = I.documents(spark, sf_dir).schema
    saved = spark.readStream.schema(schema).parquet(_either(sf_dir, "documents"))
    stream = C.as_json_configs(saved.where("doc_id % 2 = 0")).selectExpr(
        "concat('/w/', project_id) as project_id", "'project.json' as path", "if(doc_id % 19 = 0, 'delete', 'change') as kind",
        "timestamp_seconds(doc_id) as ts", "doc_id as seq", "content",
    )
    modules = C.saved_modules(spark, sf_dir).where("doc_id % 3 != 0").select("project_id", "content")
    trees = C.tree_files(spark, sf_dir)
    topics = _opened_topics(spark, sf_dir)

    def reload(latest: DataFrame, touched: DataFrame) -> DataFrame:
        opened = open_projects(
            latest.where("exists").select("project_id", "content"),
            modules.join(touched, "project_id", "left_semi"),
            trees.join(touched, F.expr("substring_index(path, '/', 3) = project_id"), "left_semi"),
            topics.join(touched, "project_id", "left_semi"),
        )
        return _opened_rows(opened)

    S.follow_reloads(stream, folder, reload).awaitTermination()
    return S.reloaded(spark, folder)


_WITHOUT_DELETED = OPENED_PROJECTS.replace("doc_id % 2 = 0 and doc_id % 13 <> 0", "doc_id % 2 = 0 and doc_id % 13 <> 0 and doc_id % 19 <> 0")
RELOAD_STREAM = f"select * from ({_WITHOUT_DELETED}) where cast(substr(project_id, 5) as bigint) % 2 = 0"

QUERIES = {
    "reload_stream": (reload_stream, RELOAD_STREAM),
    "change_latest": (change_latest, CHANGE_LATEST),
    "change_latest_stream": (change_latest_stream, CHANGE_LATEST),
    "title_changes": (title_changes, TITLE_CHANGES),
    "title_changes_stream": (title_changes_stream, TITLE_CHANGES),
    "title_rename_edits": (title_rename_edits, TITLE_RENAME_EDITS),
    "current_topics": (current_topics, CURRENT_TOPICS),
    "current_topics_stream": (current_topics_stream, CURRENT_TOPICS),
    "opened_projects": (opened_projects, OPENED_PROJECTS),
    "refused_projects": (refused_projects, REFUSED_PROJECTS),
}
