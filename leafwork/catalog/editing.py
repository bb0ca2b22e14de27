"""Registered queries: edit batches over all trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.catalog import inputs as I
from leafwork.functions import paths as P
from leafwork.operators import edits as E

KEY = ["project_id", "instance_id"]


def _edits(spark: SparkSession, sf_dir: str, where: str, op: str, **columns: str) -> DataFrame:
    """Edits derived from documents; ``seq`` is the document id unless given."""
    given = {"seq": "doc_id", "topic": "null", "target": "null", "title": "null", "file_name": "null", **columns}
    return I.documents(spark, sf_dir).where(where).selectExpr(
        f"{I.PROJECT} as project_id",
        f"{I.INSTANCE} as instance_id",
        f"cast({given['seq']} as bigint) as seq",
        f"'{op}' as op",
        *[f"cast({given[c]} as string) as {c}" for c in ("topic", "target", "title", "file_name")],
    )


def _corpus(spark: SparkSession, sf_dir: str) -> E.Corpus:
    return E.corpus_of(I.toc(spark, sf_dir), I.instances(spark, sf_dir), I.topics(spark, sf_dir))


def _tree_rows(nodes: DataFrame) -> DataFrame:
    return nodes.select(*KEY, P.path_key(F.col("node_path")).alias("path"), "topic", "title")


# Trees numbered anew: ``moved`` has node, parent and sort columns of what is left.
_RENUMBER = """
  ranked as (select *, row_number() over (partition by project_id, instance_id, parent order by late, sort) - 1 as pos from moved),
  done as (select project_id, instance_id, id, topic, title, lpad(pos::varchar, 10, '0') as path from ranked where parent is null
    union all
    select r.project_id, r.instance_id, r.id, r.topic, r.title, d.path || '.' || lpad(r.pos::varchar, 10, '0')
    from done d join ranked r on r.project_id = d.project_id and r.instance_id = d.instance_id and r.parent = d.id)
  select project_id, instance_id, path, topic, title from done
"""


def toc_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees after deleting every fifth document with what is below it."""
    edits = _edits(spark, sf_dir, "doc_id % 5 = 4", "delete", topic=I.TOPIC)
    return _tree_rows(E.apply_edits(_corpus(spark, sf_dir), edits).corpus.nodes)


# Start pages (node 1) stay; nodes below a deleted one are never reached by ``done``.
TOC_DELETE = f"""
with recursive {I.sql_toc()},
  moved as (select project_id, instance_id, node as id, parent, topic, 'old ' || doc_id as title, 0 as late, ordinal as sort
            from toc where doc_id % 5 <> 4 or node = 1), {_RENUMBER}
"""


def toc_delete_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each deletion, and the files that are left."""
    edits = _edits(spark, sf_dir, "doc_id % 5 = 4", "delete", topic=I.TOPIC)
    result = E.apply_edits(_corpus(spark, sf_dir), edits)
    outcomes = result.outcomes.select("project_id", "status", F.col("topic").alias("file"))
    return outcomes.unionByName(result.corpus.files.select("project_id", F.lit("file left").alias("status"), "file"))


TOC_DELETE_OUTCOMES = f"""
with recursive {I.sql_toc()}, {I.sql_topics()},
  gone as (select project_id, instance_id, node, doc_id, topic, true as asked from toc where doc_id % 5 = 4 and node <> 1
    union
    select b.project_id, b.instance_id, b.node, b.doc_id, b.topic, false from gone g join base b
      on b.project_id = g.project_id and b.instance_id = g.instance_id and b.parent = g.node)
select project_id, case when node = 1 then 'start page'
    when exists (select 1 from gone g where g.doc_id = t.doc_id and not g.asked) then 'topic not found' else 'applied' end as status,
  topic as file from toc t where doc_id % 5 = 4
union all
select project_id, 'file left', file from topics where file not in (select topic from gone)
"""


def toc_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees after adding children, siblings and roots."""
    title = "concat('  New ', doc_id)"
    edits = (
        _edits(spark, sf_dir, "doc_id % 6 = 0", "add_child", target=I.TOPIC, title=title)
        .unionByName(_edits(spark, sf_dir, "doc_id % 6 = 1", "add_sibling", target=I.TOPIC, title=title, file_name="concat('s', doc_id, '.md')"))
        .unionByName(_edits(spark, sf_dir, "doc_id % 30 = 2", "add_root", title=title))
    )
    return _tree_rows(E.apply_edits(_corpus(spark, sf_dir), edits).corpus.nodes)


TOC_ADD = f"""
with recursive {I.sql_toc()},
  moved as (
    select project_id, instance_id, node as id, parent, topic, 'old ' || doc_id as title, 0 as late, ordinal as sort from toc
    union all
    select project_id, instance_id, -1 - node, case doc_id % 6 when 0 then node when 1 then parent end,
      case doc_id % 6 when 1 then 's' || doc_id || '.md' else 'new-' || doc_id || '.md' end, '  New ' || doc_id, 1, doc_id
    from toc where doc_id % 6 <= 1 or doc_id % 30 = 2), {_RENUMBER}
"""


def toc_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees after taking out nodes but not their files; the files stay as they were."""
    edits = _edits(spark, sf_dir, "doc_id % 8 = 5", "remove", topic=I.TOPIC)
    result = E.apply_edits(_corpus(spark, sf_dir), edits).corpus
    files = result.files.select(
        "project_id", F.lit("").alias("instance_id"), F.lit("file").alias("path"), F.col("file").alias("topic"),
        F.lit(None).cast("string").alias("title"),
    )
    return _tree_rows(result.nodes).unionByName(files)


TOC_REMOVE = f"""
with recursive {I.sql_toc()}, {I.sql_topics()},
  moved as (select project_id, instance_id, node as id, parent, topic, 'old ' || doc_id as title, 0 as late, ordinal as sort
            from toc where doc_id % 8 <> 5), {_RENUMBER}
union all
select project_id, '', 'file', file, null from topics
"""


def toc_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees after moving every seventh node below the first root."""
    first_root = "concat('doc-', case doc_id % 3 when 0 then 0 else 600 * (doc_id div 600) + doc_id % 3 end, '.md')"
    edits = _edits(spark, sf_dir, f"{I.RANK} % 7 = 5", "move", topic=I.TOPIC, target=first_root)
    return _tree_rows(E.apply_edits(_corpus(spark, sf_dir), edits).corpus.nodes)


# Children of the first root stay where they are.
TOC_MOVE = f"""
with recursive {I.sql_toc()},
  moved as (select project_id, instance_id, node as id, case when node % 7 = 5 then 0 else parent end as parent, topic,
              'old ' || doc_id as title, case when node % 7 = 5 and parent <> 0 then 1 else 0 end as late,
              case when node % 7 = 5 and parent <> 0 then doc_id else ordinal end as sort from toc), {_RENUMBER}
"""


def toc_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, files and start pages after renaming every fourth document."""
    edits = _edits(spark, sf_dir, "doc_id % 4 = 1", "rename", topic=I.TOPIC, title="concat('Re named ', doc_id)")
    # Instance 'b' has one root, so its start page follows the renames.
    corpus = E.corpus_of(I.toc(spark, sf_dir), I.instances(spark, sf_dir), I.topics(spark, sf_dir))
    result = E.apply_edits(corpus, edits).corpus
    pages = result.instances.select(*KEY, F.lit("start page").alias("path"), F.col("start_page").alias("topic"), F.col("name").alias("title"))
    return _tree_rows(result.nodes).unionByName(pages)


TOC_RENAME = f"""
with recursive {I.sql_toc()},
last as (select project_id, instance_id, max(doc_id) as d from toc where doc_id % 4 = 1 and instance_id = 'b' group by all)
select project_id, instance_id, path, case when doc_id % 4 = 1 then 're-named-' || doc_id || '.md' else topic end as topic,
  case when doc_id % 4 = 1 then 'Re named ' else 'old ' end || doc_id as title from toc
union all
select b.project_id, b.instance_id, 'start page', coalesce('re-named-' || l.d || '.md', topic), 'Guide ' || b.instance_id
from base b left join last l on l.project_id = b.project_id and l.instance_id = b.instance_id where node = 1
"""


def edit_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic contents after editing the titles of a third of the documents."""
    edits = _edits(spark, sf_dir, "doc_id % 9 < 3", "edit_title", topic=I.TOPIC, title="concat('T ', doc_id)")
    topics = I.topics(spark, sf_dir)
    result = E.apply_edits(_corpus(spark, sf_dir), edits).corpus
    return E.materialise(result.files, topics).select("project_id", "file", F.md5("content").alias("digest"))


EDIT_TITLES = rf"""
with {I.sql_topics()}, cut as (select *, regexp_extract(content, '\A\s*# [^\n]*', 0) as head from topics)
select project_id, case when doc_id % 9 < 3 then 't-' || doc_id || '.md' else file end as file,
  md5(case when doc_id % 9 >= 3 then content
    when regexp_extract(content, '\A\s*# [ \t]*[^\s]', 0) <> ''
      then regexp_extract(head, '\A(?:\s*\n)?', 0) || '# T ' || doc_id || substr(content, length(head) + 1)
    else '# T ' || doc_id || chr(10) || content end) as digest
from cut
"""


def edit_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of edits on all projects, mixed in order, with chains that depend on each other.

    A document's edits follow each other at ten times its id: renames and deletions by the
    new name, roots added and moved below the first root of their tree, children added
    and removed again, siblings, edited titles, start pages, instance names, instances
    created (their files share a name) and deleted again.
    """
    at = lambda k: f"doc_id * 10 + {k}"
    first = "concat('doc-', case when doc_id % 3 = 0 then 0 else doc_id div 600 * 600 + doc_id % 3 end, '.md')"
    own = lambda letter: F.expr(f"concat('{letter}', seq div 10)")
    parts = [
        _edits(spark, sf_dir, "doc_id % 20 in (5, 9, 11) and doc_id % 3 != 2", "rename", seq=at(0), topic=I.TOPIC, title="concat('N ', doc_id)"),
        _edits(spark, sf_dir, "doc_id % 20 = 11 and doc_id % 3 != 2", "delete", seq=at(1), topic="concat('n-', doc_id, '.md')"),
        _edits(spark, sf_dir, "doc_id % 40 = 3", "add_root", seq=at(2), title="concat('A ', doc_id)"),
        _edits(spark, sf_dir, "doc_id % 80 = 3", "move", seq=at(3), topic="concat('a-', doc_id, '.md')", target=first),
        _edits(spark, sf_dir, "doc_id % 40 = 7", "add_child", seq=at(2), target=I.TOPIC, title="concat('C ', doc_id)"),
        _edits(spark, sf_dir, "doc_id % 80 = 7", "remove", seq=at(3), topic="concat('c-', doc_id, '.md')"),
        _edits(spark, sf_dir, "doc_id % 40 = 13", "add_sibling", seq=at(2), target=I.TOPIC, title="concat('S ', doc_id)"),
        _edits(spark, sf_dir, "doc_id % 40 = 39 and doc_id % 3 != 2", "edit_title", seq=at(4), topic=I.TOPIC, title="concat('E ', doc_id)"),
        _edits(spark, sf_dir, "doc_id % 25 = 4", "set_start", seq=at(5), topic=I.TOPIC),
        _edits(spark, sf_dir, "doc_id % 35 = 6", "rename_instance", seq=at(6), title="concat('Named ', doc_id)"),
        _edits(spark, sf_dir, "doc_id % 70 = 5", "create_instance", seq=at(7), title="'Fresh'").withColumn("instance_id", own("x")),
        _edits(spark, sf_dir, "doc_id % 70 = 25", "create_instance", seq=at(7), title="concat('Gone ', doc_id)").withColumn("instance_id", own("y")),
        _edits(spark, sf_dir, "doc_id % 140 = 25", "delete_instance", seq=at(8)).withColumn("instance_id", own("y")),
    ]
    result = E.apply_edits(_corpus(spark, sf_dir), reduce(DataFrame.unionByName, parts)).corpus
    rows = result.instances.select(*KEY, F.lit("instance").alias("path"), F.col("start_page").alias("topic"), F.col("name").alias("title"))
    return _tree_rows(result.nodes).unionByName(rows)


# Trees with renamed nodes keep several roots, so renames leave start pages alone.
EDIT_BATCH = f"""
with recursive {I.sql_toc()},
  labelled as (
    select *, doc_id % 20 in (5, 9, 11) and doc_id % 3 <> 2 as renamed, doc_id % 40 = 39 and doc_id % 3 <> 2 as edited from toc
    where not (doc_id % 20 = 11 and doc_id % 3 <> 2)),
  moved as (
    select project_id, instance_id, node as id, parent,
      case when renamed then 'n-' || doc_id || '.md' when edited then 'e-' || doc_id || '.md' else topic end as topic,
      case when renamed then 'N ' when edited then 'E ' else 'old ' end || doc_id as title, 0 as late, ordinal as sort from labelled
    union all
    select project_id, instance_id, -1 - node,
      case when doc_id % 80 = 3 then 0 when doc_id % 40 = 7 then node when doc_id % 40 = 13 then parent end,
      case doc_id % 40 when 3 then 'a-' when 7 then 'c-' else 's-' end || doc_id || '.md',
      case doc_id % 40 when 3 then 'A ' when 7 then 'C ' else 'S ' end || doc_id, 1,
      doc_id * 10 + case when doc_id % 80 = 3 then 3 else 2 end
    from base where doc_id % 40 in (3, 7, 13) and doc_id % 80 <> 7),
  pages as (select project_id, instance_id, max_by(topic, doc_id) as topic from base where doc_id % 25 = 4 group by all),
  names as (select project_id, instance_id, 'Named ' || max(doc_id) as title from base where doc_id % 35 = 6 group by all),
  made as (
    select project_id, 'x' || doc_id as instance_id, 'Fresh' as title,
      'fresh' || case when r = 0 then '' else r::varchar end || '.md' as topic
    from (select *, row_number() over (partition by project_id order by doc_id) - 1 as r from base where doc_id % 70 = 5)
    union all
    select project_id, 'y' || doc_id, 'Gone ' || doc_id, 'gone-' || doc_id || '.md' from base where doc_id % 140 = 95),
{_RENUMBER}
union all
select b.project_id, b.instance_id, 'instance', coalesce(p.topic, b.topic), coalesce(n.title, 'Guide ' || b.instance_id)
from base b left join pages p using (project_id, instance_id) left join names n using (project_id, instance_id) where node = 1
union all
select project_id, instance_id, 'instance', topic, title from made
union all
select project_id, instance_id, '0000000000', topic, 'About ' || title from made
"""

QUERIES = {
    "toc_delete": (toc_delete, TOC_DELETE),
    "toc_delete_outcomes": (toc_delete_outcomes, TOC_DELETE_OUTCOMES),
    "toc_remove": (toc_remove, TOC_REMOVE),
    "toc_add": (toc_add, TOC_ADD),
    "toc_move": (toc_move, TOC_MOVE),
    "toc_rename": (toc_rename, TOC_RENAME),
    "edit_titles": (edit_titles, EDIT_TITLES),
    "edit_batch": (edit_batch, EDIT_BATCH),
}
