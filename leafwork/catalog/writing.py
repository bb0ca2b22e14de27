"""Registered queries: files to write, names and instance changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.catalog import configs as C
from leafwork.catalog import inputs as I
from leafwork.functions import paths as P
from leafwork.operators import instances as N
from leafwork.operators import lookup, naming
from leafwork.sinks import documents as D
from leafwork.sinks import topics as T
from leafwork.session import cut_lineage
from leafwork.sources import json_blocks, json_config, xml_config

KEY = ["project_id", "instance_id"]
END = "2147483647"


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.instances(spark, sf_dir).groupBy("project_id").agg(
        F.lit("docs").alias("topics_dir"),
        F.min("project_id").alias("images_dir"),
        F.lit("1.0").alias("images_version"),
        F.lit(None).cast("string").alias("images_web_path"),
    )


def tree_xml_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree files of all instances, in pieces."""
    pieces = D.tree_pieces(I.instances(spark, sf_dir), I.toc(spark, sf_dir))
    return pieces.select(*KEY, P.path_key(F.col("key")).alias("key"), "text")


# Fixed value: the head of a tree file.
_DOCTYPE = "<!DOCTYPE instance-profile SYSTEM \"https://resources.jetbrains.com/writerside/1.0/product-profile.dtd\">"
_TREE_TEXT = f"""
  pieced as (
    select project_id, instance_id, '0000000000' as key,
      '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '{_DOCTYPE}' || chr(10) || chr(10) ||
      '<instance-profile id="' || instance_id || '" name="Guide ' || instance_id || '" start-page="' ||
      case when instance_id = 'b' then (select r.topic from base r where r.project_id = b.project_id and r.instance_id = b.instance_id and r.node = 0)
           else topic end || '">' || chr(10) as text from base b where node = 1
    union all
    select project_id, instance_id, '0000000000.{END}', '</instance-profile>' || chr(10) from base where node = 1
    union all
    select project_id, instance_id, '0000000000.' || path, repeat('    ', depth + 1) || '<toc-element topic="' || topic || '"' ||
      case when inner_node then '>' else '/>' end || chr(10) from flagged
    union all
    select project_id, instance_id, '0000000000.' || path || '.{END}', repeat('    ', depth + 1) || '</toc-element>' || chr(10)
    from flagged where inner_node)
"""
_FLAGGED = """
  flagged as (select t.*, exists (select 1 from {source} c where c.project_id = t.project_id and c.instance_id = t.instance_id
      and c.parent_path = t.path) as inner_node,
      t.ordinal = max(t.ordinal) over (partition by t.project_id, t.instance_id, t.parent_path) as is_last from {source} t)
"""
_TREE_CTES = _TREE_TEXT.replace("pieced as (", _FLAGGED.format(source="toc").strip() + ",\n  pieced as (")
TREE_XML_PIECES = f"""
with recursive {I.sql_toc()}, {_TREE_CTES}
select project_id, instance_id, key, text from pieced
"""


def tree_xml_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tree files as texts, in blocks of 500 pieces (length and digest of each)."""
    text = D.assemble(D.tree_pieces(I.instances(spark, sf_dir), I.toc(spark, sf_dir)), KEY, block=500)
    return text.select(*KEY, "block", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


TREE_XML_TEXT = f"""
with recursive {I.sql_toc()}, {_TREE_CTES},
  placed as (select *, (row_number() over (partition by project_id, instance_id order by key) - 1) // 500 as block from pieced),
  whole as (select project_id, instance_id, block, string_agg(text, '' order by key) as content from placed group by all)
select project_id, instance_id, block, length(content) as n_chars, md5(content) as digest from whole
"""


def json_config_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON configurations of all projects, in pieces."""
    pieces = D.config_pieces(_projects(spark, sf_dir), I.instances(spark, sf_dir), I.toc(spark, sf_dir))
    return pieces.select("project_id", P.path_key(F.col("key")).alias("key"), "text")


JSON_CONFIG_PIECES = f"""
with recursive {I.sql_toc()}, {_FLAGGED.format(source="toc")},
inst as (select project_id, instance_id, topic, doc_id % 3 as ord,
           doc_id % 3 = max(doc_id % 3) over (partition by project_id) as is_last from base where node = 1),
ordered as (select f.*, i.ord, repeat('    ', 2 * depth + 4) as pad, lpad(i.ord::varchar, 10, '0') || '.' || path as k
            from flagged f join inst i using (project_id, instance_id))
select project_id, '' as key, '{{' || chr(10) || '    "topics": {{' || chr(10) || '        "dir": "docs"' || chr(10) || '    }},' || chr(10)
  || '    "images": {{' || chr(10) || '        "dir": "' || project_id || '",' || chr(10) || '        "version": "1.0"' || chr(10) || '    }},' || chr(10)
  || '    "instances": [' || chr(10) as text from (select distinct project_id from inst)
union all
select distinct project_id, '{END}', '    ]' || chr(10) || '}}' from inst
union all
select project_id, lpad(ord::varchar, 10, '0'), '        {{' || chr(10) || '            "id": "' || instance_id || '",' || chr(10)
  || '            "name": "Guide ' || instance_id || '",' || chr(10) || '            "start-page": "' || topic || '",' || chr(10)
  || '            "toc-elements": [' || chr(10) from inst
union all
select project_id, lpad(ord::varchar, 10, '0') || '.{END}', '            ]' || chr(10) || '        }}' || case when is_last then '' else ',' end || chr(10) from inst
union all
select project_id, k, pad || '{{' || chr(10) || pad || '    "topic": "' || topic || '",' || chr(10) || pad || '    "title": "old ' || doc_id || '",' || chr(10)
  || pad || '    "children": [' || case when inner_node then chr(10) else ']' || chr(10) || pad || '}}' || case when is_last then '' else ',' end || chr(10) end from ordered
union all
select project_id, k || '.{END}', pad || '    ]' || chr(10) || pad || '}}' || case when is_last then '' else ',' end || chr(10) from ordered where inner_node
"""


def module_xml_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module configurations with suppliers as registered instances of their nation."""
    suppliers = I.table(spark, sf_dir, "supplier")
    projects = suppliers.groupBy(F.concat(F.lit("n"), "s_nationkey").alias("project_id")).agg(
        F.lit("topics").alias("topics_dir"),
        F.lit(None).cast("string").alias("images_dir"),
        F.lit(None).cast("string").alias("images_version"),
        F.lit(None).cast("string").alias("images_web_path"),
    )
    registry = suppliers.selectExpr(
        "concat('n', s_nationkey) as project_id", "s_suppkey as ordinal",
        "concat(s_name, ' & co', '.tree') as src", "'1.0' as version",
    )
    pieces = D.module_pieces(projects, registry)
    return pieces.select("project_id", P.path_key(F.col("key")).alias("key"), "text")


MODULE_XML_PIECES = f"""
select distinct 'n' || s_nationkey as project_id, '0000000000' as key, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10)
  || '<ihp version="2.0">' || chr(10) || '    <topics dir="topics"/>' || chr(10) as text from supplier
union all
select distinct 'n' || s_nationkey, '0000000000.{END}', '</ihp>' || chr(10) from supplier
union all
select 'n' || s_nationkey, '0000000000.0000000001.' || lpad(s_suppkey::varchar, 10, '0'),
  '    <instance src="' || s_name || ' &amp; co.tree" version="1.0"/>' || chr(10) from supplier
"""


def topic_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stubs for all documents that have no topic file."""
    wanted = I.documents(spark, sf_dir).selectExpr(
        f"{I.PROJECT} as project_id", f"{I.TOPIC} as file", "concat('Doc ', doc_id) as title", "doc_id as seq"
    )
    return T.new_stubs(wanted, I.topics(spark, sf_dir))


TOPIC_STUBS = f"""
select {I._SQL['project']} as project_id, {I._SQL['topic']} as file,
  '# Doc ' || doc_id || chr(10) || chr(10) || 'Content goes here...' as content from documents where doc_id % 11 = 0
"""


def topic_file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics after deleting and renaming files; two files may want one name."""
    topics = I.topics(spark, sf_dir)
    ids = I.documents(spark, sf_dir).selectExpr(f"{I.PROJECT} as project_id", f"{I.TOPIC} as file", "doc_id as seq")
    left = T.delete_files(topics, ids.where("seq % 9 = 0"))
    renames = ids.where("seq % 5 = 0").withColumn("new_file", F.expr("concat('moved-', seq div 30, '.md')"))
    return T.rename_files(left, renames).select("project_id", "file", F.md5("content").alias("digest"))


TOPIC_FILE_CHANGES = f"""
with {I.sql_topics()}, kept as (select * from topics where doc_id % 9 <> 0),
asked as (select *, row_number() over (partition by project_id, doc_id // 30 order by doc_id) as rn from kept where doc_id % 5 = 0)
select k.project_id, case when a.rn = 1 then 'moved-' || (k.doc_id // 30) || '.md' else k.file end as file, md5(k.content) as digest
from kept k left join asked a on a.doc_id = k.doc_id
"""


def unique_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free file names for parts as topic titles, per brand, past the names in use."""
    parts = I.table(spark, sf_dir, "part")
    requests = parts.where("p_partkey % 3 != 0").selectExpr(
        "p_brand as project_id", "p_partkey as seq", "p_name as title"
    )
    # Every second size is in use as an alternative number.
    used = parts.where("p_partkey % 3 = 0").selectExpr(
        "p_brand as project_id",
        "concat(replace(p_name, ' ', '-'), if(p_size % 4 = 0, '', cast(p_size as string)), '.md') as file",
    ).distinct()
    return naming.unique_files(requests, used).select("project_id", "seq", "file")


UNIQUE_FILE_NAMES = """
with asked as (
  select p_brand, p_partkey, p_name, row_number() over (partition by p_brand, p_name order by p_partkey) as r
  from part where p_partkey % 3 <> 0),
used as (select distinct p_brand, p_name, case when p_size % 4 = 0 then 0 else p_size end as n from part where p_partkey % 3 = 0),
free as (
  select g.p_brand, g.p_name, c.n, row_number() over (partition by g.p_brand, g.p_name order by c.n) as r
  from (select distinct p_brand, p_name from asked) g
  cross join (select range as n from range(0, (select max(r) + 200 from asked)::bigint)) c
  where not exists (select 1 from used u where u.p_brand = g.p_brand and u.p_name = g.p_name and u.n = c.n))
select a.p_brand as project_id, a.p_partkey as seq,
  replace(a.p_name, ' ', '-') || case when f.n = 0 then '' else f.n::varchar end || '.md' as file
from asked a join free f using (p_brand, p_name, r)
"""


def unique_instance_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free instance ids for customers, whose default ids repeat within a nation."""
    wanted = I.table(spark, sf_dir, "customer").selectExpr(
        "concat('n', c_nationkey) as project_id", "c_custkey as seq", "lower(left(c_mktsegment, 2)) as wanted_id"
    )
    taken = I.table(spark, sf_dir, "supplier").selectExpr(
        "concat('n', s_nationkey) as project_id",
        "concat(case s_suppkey % 3 when 0 then 'bu' when 1 then 'au' else 'ho' end, case s_suppkey % 4 when 1 then '1' when 2 then '12' else '' end) as instance_id",
    ).distinct()
    return naming.unique_instance_ids(wanted, taken).select("project_id", "seq", "instance_id")


UNIQUE_INSTANCE_IDS = """
with asked as (
  select c_nationkey as nk, c_custkey, lower(left(c_mktsegment, 2)) as id,
    row_number() over (partition by c_nationkey, left(c_mktsegment, 2) order by c_custkey) as r
  from customer),
used as (select distinct s_nationkey as nk, case s_suppkey % 3 when 0 then 'bu' when 1 then 'au' else 'ho' end as id,
           case s_suppkey % 4 when 1 then 1 when 2 then 2 else 0 end as n from supplier),
free as (
  select g.nk, g.id, c.n, row_number() over (partition by g.nk, g.id order by c.n) as r
  from (select distinct nk, id from asked) g cross join (select range as n from range(0, (select max(r) + 10 from asked)::bigint)) c
  where not exists (select 1 from used u where u.nk = g.nk and u.id = g.id and u.n = c.n))
select 'n' || a.nk as project_id, a.c_custkey as seq,
  a.id || array_to_string(list_transform(range(1, f.n + 1), lambda x: x::varchar), '') as instance_id
from asked a join free f on f.nk = a.nk and f.id = a.id and f.r = a.r
"""


def _customer_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as instances; orders name those with an even number, others have another id."""
    return I.table(spark, sf_dir, "customer").selectExpr(
        "concat('n', c_nationkey) as project_id", "concat(if(c_custkey % 2 = 0, 'c', 'k'), c_custkey) as instance_id",
        "c_name as name", "concat(c_mktsegment, '.md') as start_page", "c_custkey as ordinal",
    )


def instance_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as instances, replaced or appended with their trees by the orders that name them."""
    ordered = I.table(spark, sf_dir, "orders").join(
        I.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey")
    )
    changes = ordered.selectExpr(
        "concat('n', c_nationkey) as project_id", "concat('c', o_custkey) as instance_id",
        "concat('order ', o_orderkey) as name", "concat(o_orderstatus, '.md') as start_page", "o_orderkey as seq",
    )
    old = _customer_instances(spark, sf_dir)
    nodes = old.select(*KEY, F.expr("array(0)").alias("node_path"), F.concat("instance_id", F.lit(".md")).alias("topic"))
    # Each change brings two roots, or none.
    brought = changes.where("seq % 3 != 0").selectExpr(*KEY, "seq", "explode(array(0, 1)) as i").selectExpr(
        *KEY, "seq", "array(i) as node_path", "concat('o', seq, '-', i, '.md') as topic"
    )
    trees = N.upsert_trees(nodes, changes, brought).select(
        *KEY, F.lit("node").alias("name"), F.col("topic").alias("start_page"), F.col("node_path")[0].cast("bigint").alias("ordinal")
    )
    return N.upsert(old, changes).unionByName(trees)


_OLD = """old as (select 'n' || c_nationkey as p, case when c_custkey % 2 = 0 then 'c' else 'k' end || c_custkey as i, c_name as name,
  c_mktsegment || '.md' as sp, c_custkey as ordinal from customer)"""
INSTANCE_UPSERT = f"""
with {_OLD},
ch as (select 'n' || c_nationkey as p, 'c' || o_custkey as i, arg_max('order ' || o_orderkey, o_orderkey) as name,
         arg_max(o_orderstatus || '.md', o_orderkey) as sp, min(o_orderkey) as seq, max(o_orderkey) as last
       from orders join customer on o_custkey = c_custkey group by 1, 2),
fresh as (select ch.*, row_number() over (partition by p order by seq) as r from ch where i not in (select i from old)),
ends as (select p, max(ordinal) as e from old group by 1)
select old.p as project_id, old.i as instance_id, coalesce(ch.name, old.name) as name, coalesce(ch.sp, old.sp) as start_page, ordinal
from old left join ch on ch.p = old.p and ch.i = old.i
union all
select fresh.p, fresh.i, name, sp, coalesce(e, -1) + r from fresh left join ends on ends.p = fresh.p
union all
select p, i, 'node', i || '.md', 0 from old where i not in (select i from ch)
union all
select p, i, 'node', 'o' || last || '-' || k || '.md', k from ch, (select unnest([0, 1]) as k) where last % 3 <> 0
"""


def instance_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances, nodes, files, registry entries and tree files left without every project's instance ``b``."""
    tree_path = F.expr("if(dialect = 'X', concat(project_id, '/', instance_id, '.tree'), null)")
    dialects = I.toc(spark, sf_dir).select(*KEY, "dialect").distinct()
    instances = I.instances(spark, sf_dir).drop("tree_path").join(dialects, KEY).withColumn("tree_path", tree_path)
    entries = instances.where("tree_path is not null")
    registry = entries.select("project_id", "ordinal", F.concat("instance_id", F.lit(".tree")).alias("src"))
    gone = I.instances(spark, sf_dir).where("instance_id = 'b'")
    left = N.delete_all(gone, instances, I.toc(spark, sf_dir), I.topics(spark, sf_dir).select("project_id", "file"), registry, entries.select(F.col("tree_path").alias("path")))
    row = lambda df, what, name, place: df.select("project_id", F.lit(what).alias("what"), F.expr(name).alias("name"), F.expr(place).alias("place"))
    return (
        row(left.nodes.withColumn("path", P.path_key(F.col("node_path"))), "node", "topic", "concat(instance_id, ' ', path)")
        .unionByName(row(left.instances, "instance", "name", "instance_id"))
        .unionByName(row(left.files, "file", "file", "''"))
        .unionByName(row(left.registry, "entry", "src", "string(ordinal)"))
        .unionByName(row(left.trees.withColumn("project_id", F.substring_index("path", "/", 1)), "tree", "path", "''"))
    )


INSTANCE_DELETE = f"""
with recursive {I.sql_toc()}, {I.sql_topics()},
kept as (select * from base where node = 1 and instance_id <> 'b')
select project_id, 'node' as what, topic as name, instance_id || ' ' || path as place from toc where instance_id <> 'b'
union all select project_id, 'instance', 'Guide ' || instance_id, instance_id from kept
union all select project_id, 'file', file, '' from topics where doc_id % 3 <> 2
union all select project_id, 'entry', instance_id || '.tree', (doc_id % 3)::varchar from kept where dialect = 'X'
union all select project_id, 'tree', project_id || '/' || instance_id || '.tree', '' from kept where dialect = 'X'
"""


def instance_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New instances named after parts: start page, root title and stub."""
    requests = I.table(spark, sf_dir, "part").selectExpr(
        "p_brand as project_id", "concat('i', p_partkey) as instance_id", "p_name as title", "p_partkey as seq"
    )
    existing = requests.where("seq % 10 = 0").select("project_id", "instance_id")
    files = I.table(spark, sf_dir, "part").where("p_size = 7").selectExpr(
        "p_brand as project_id", "concat(replace(p_name, ' ', '-'), '.md') as file"
    ).distinct()
    return N.create(requests, existing, files).drop("seq")


INSTANCE_CREATE = """
with asked as (select *, row_number() over (partition by p_brand, p_name order by p_partkey) as r from part where p_partkey % 10 <> 0),
used as (select distinct p_brand, p_name, true as hit from part where p_size = 7),
n as (select a.*, a.r - 1 + case when u.hit then 1 else 0 end as n from asked a left join used u using (p_brand, p_name))
select p_brand as project_id, 'i' || p_partkey as instance_id, p_name as name,
  replace(p_name, ' ', '-') || case when n = 0 then '' else n::varchar end || '.md' as start_page,
  'About ' || p_name as root_title,
  '# About ' || p_name || chr(10) || chr(10) || 'Content goes here...' as content from n
"""


def instance_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instance listing after renames; the last name given counts."""
    names = I.table(spark, sf_dir, "orders").join(
        I.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey")
    ).selectExpr(
        "concat('n', c_nationkey) as project_id", "concat('c', o_custkey) as instance_id",
        "o_orderpriority as name", "o_orderkey as seq",
    )
    return N.listing(N.rename(_customer_instances(spark, sf_dir), names))


INSTANCE_RENAMES = """
with l as (select o_custkey, arg_max(o_orderpriority, o_orderkey) as name from orders group by 1)
select 'n' || c_nationkey as project_id, case when c_custkey % 2 = 0 then 'c' else 'k' end || c_custkey as instance_id,
  coalesce(l.name, c_name) as name, c_custkey as ordinal
from customer left join l on o_custkey = c_custkey and c_custkey % 2 = 0
"""

# Each priority class of orders is a project.
_CLASSES = "'1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'"


def _ordered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority as project_id", "concat('c', o_custkey) as instance_id",
        "concat('order ', o_orderkey) as name", "o_orderkey as ordinal",
    )


def _wanted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's id in every project."""
    return I.table(spark, sf_dir, "customer").selectExpr(
        f"explode(array({_CLASSES})) as project_id", "concat('c', c_custkey) as instance_id"
    )


def instance_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First instance of each wanted id in each project, where orders repeat a customer's id."""
    return lookup.find_instances(_wanted_ids(spark, sf_dir), _ordered_ids(spark, sf_dir))


_WANTED = f"wanted as (select unnest([{_CLASSES}]) as project_id, 'c' || c_custkey as instance_id from customer)"
INSTANCE_LOOKUP = f"""
with {_WANTED},
f as (select o_orderpriority as project_id, 'c' || o_custkey as instance_id, min(o_orderkey) as k from orders group by all)
select project_id, instance_id, 'order ' || f.k as name, f.k as ordinal, f.k is not null as found
from wanted left join f using (project_id, instance_id)
"""


def free_instance_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose id no order has taken, in each priority class."""
    return lookup.unique_ids(_wanted_ids(spark, sf_dir), _ordered_ids(spark, sf_dir))


FREE_INSTANCE_IDS = f"""
with {_WANTED}
select project_id, instance_id from wanted
where not exists (from orders where o_orderpriority = project_id and 'c' || o_custkey = instance_id)
"""

# Every field a configuration may have, in nested nodes too.
_FULL_NODE = """named_struct('id', concat('n', doc_id, '-', {i}), 'topic', concat({i}, '.md'), 'path', if(doc_id % 2 = 0, 'p/q', null),
  'toc-title', {line}, 'title', concat('t ', length({line})), 'sort-children', if(doc_id % 3 = 0, 'ascending', null),
  'sortChildren', if(doc_id % 3 = 1, 'none', null), 'children', {children})"""


def full_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON configurations in which every optional field occurs: lines are nodes, sentences their children."""
    inner = _FULL_NODE.format(i="concat('l', i, '-', j)", line="s", children="array_repeat('', 0)")
    outer = _FULL_NODE.format(i="concat('l', i)", line="line", children=f"transform(split(line, '\\\\. '), (s, j) -> {inner})")
    return I.documents(spark, sf_dir).selectExpr(
        "concat('d', doc_id) as project_id",
        f"""to_json(named_struct('schema', concat('https://s/', lang), 'title', source, 'type', if(doc_id % 2 = 0, 'object', null),
          'topics', named_struct('dir', 'docs'), 'images', named_struct('dir', 'i', 'version', '2', 'web-path', 'w'),
          'instances', array(named_struct('id', lang, 'name', concat(source, ' "&"'), 'start-page', 'l0.md',
            'toc-elements', transform(split(text, '\\n'), (line, i) -> {outer}))))) as content""",
    )


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations read, written, and read again: all fields of nodes and configurations."""
    given = full_configs(spark, sf_dir)
    # The writer joins instances several times; the texts they come from are read once.
    listed = cut_lineage(json_config.instances(given))
    pieces = D.config_pieces(json_config.projects(given), listed, json_config.nodes(given))
    # Long configurations come in several blocks, which are read as they are.
    whole, several = json_config.in_one_and_several(cut_lineage(D.assemble(pieces, ["project_id"], block=1000)))
    values = json_blocks.values(several)
    more = lambda n: F.element_at("more", n)
    none = F.lit(None).cast("string")
    read = json_config.nodes(whole).drop("dialect").unionByName(json_blocks.nodes(values, json_config.MORE))
    nodes = read.select(
        "project_id", P.path_key(F.col("node_path")).alias("place"), "topic", "title", more("id").alias("id"), more("path").alias("path"),
        more("toc-title").alias("toc_title"), F.coalesce(more("sort-children"), more("sortChildren")).alias("sort"),
    )
    tops = json_config.projects(whole.unionByName(json_blocks.tops(values))).select(
        "project_id", F.lit("top").alias("place"), F.concat_ws("|", "topics_dir", "images_dir", "images_version", "images_web_path").alias("topic"),
        more("title").alias("title"), more("schema").alias("id"), more("type").alias("path"), none.alias("toc_title"), none.alias("sort"),
    )
    instances = json_config.instances(whole).unionByName(json_config.instances_in_blocks(values)).select(
        "project_id", F.lit("instance").alias("place"), F.col("start_page").alias("topic"), F.col("name").alias("title"),
        F.col("instance_id").alias("id"), none.alias("path"), none.alias("toc_title"), none.alias("sort"),
    )
    return nodes.unionByName(tops).unionByName(instances)


_SORT = "case doc_id % 3 when 0 then 'ascending' when 1 then 'none' end as sort"
JSON_ROUNDTRIP = f"""
with {C.SQL_LINES}
select 'd' || doc_id as project_id, lpad(i::varchar, 10, '0') as place, 'l' || i || '.md' as topic, 't ' || length(line) as title,
  'n' || doc_id || '-l' || i as id, case when doc_id % 2 = 0 then 'p/q' end as path, line as toc_title, {_SORT} from lines
union all
select 'd' || doc_id, lpad(i::varchar, 10, '0') || '.' || lpad(j::varchar, 10, '0'), 'l' || i || '-' || j || '.md', 't ' || length(s),
  'n' || doc_id || '-l' || i || '-' || j, case when doc_id % 2 = 0 then 'p/q' end, s, {_SORT} from sents
union all
select 'd' || doc_id, 'top', 'docs|i|2|w', source, 'https://s/' || lang, case when doc_id % 2 = 0 then 'object' end, null, null from documents
union all
select 'd' || doc_id, 'instance', 'l0.md', source || ' "&"', lang, null, null, null from documents
"""


def module_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module configurations read, written, and read again: every element, as it was written."""
    given = I.documents(spark, sf_dir).selectExpr(
        "concat('d', doc_id) as project_id",
        """concat('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE ihp SYSTEM "ihp.dtd">\n<ihp version="2.', doc_id % 5, '" id="', lang, '">\n',
          '  <topics dir="docs" web-path="', source, '"/>\n  <!-- note ', doc_id, ' -->\n  <images dir="i" web-path="w"/>\n',
          array_join(transform(sequence(1, cast(doc_id % 3 + 1 as int)), n -> concat('  <instance src="t', n, '.tree" version="1.', n, '" web-path="x>y"/>\n')), ''),
          '  <vars src="v.list"><var name="a &amp; b">', lang, '</var></vars>\n  <?keep it="', doc_id, '"?>\n',
          '  <group id="', lang, '">', repeat('<group a="/>">', cast(doc_id % 4 as int)), '<![CDATA[</group>]]><leaf/>',
          repeat('</group>', cast(doc_id % 4 as int)), '</group>\n  bare &lt;text&gt; of ', source, '\n  <group/>\n</ihp>\n') as content""",
    )
    elements = xml_config.elements(given)
    pieces = D.module_pieces(xml_config.projects(given), xml_config.written_registry(given), elements)
    again = D.assemble(pieces, ["project_id"]).select("project_id", "content")
    back = xml_config.elements(again).select("project_id", "tag", "text")
    dirs = xml_config.projects(again).select(
        "project_id", F.lit("dirs").alias("tag"), F.concat_ws("|", "topics_dir", "images_dir", "images_web_path").alias("text")
    )
    return back.unionByName(dirs)


MODULE_ROUNDTRIP = """
select 'd' || doc_id as project_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<!DOCTYPE ihp SYSTEM "ihp.dtd">' || chr(10) || '<ihp' as tag,
  'version="2.' || (doc_id % 5) || '" id="' || lang || '"' as text from documents
union all select 'd' || doc_id, 'topics', '<topics dir="docs" web-path="' || source || '"/>' from documents
union all select 'd' || doc_id, null, '<!-- note ' || doc_id || ' -->' from documents
union all select 'd' || doc_id, 'images', '<images dir="i" web-path="w"/>' from documents
union all select 'd' || doc_id, 'vars', '<vars src="v.list"><var name="a &amp; b">' || lang || '</var></vars>' from documents
union all select 'd' || doc_id, null, '<?keep it="' || doc_id || '"?>' from documents
union all select 'd' || doc_id, 'group', '<group id="' || lang || '">' || repeat('<group a="/>">', (doc_id % 4)::int) || '<![CDATA[</group>]]><leaf/>'
  || repeat('</group>', (doc_id % 4)::int) || '</group>' from documents
union all select 'd' || doc_id, null, 'bare &lt;text&gt; of ' || source from documents
union all select 'd' || doc_id, 'group', '<group/>' from documents
union all select 'd' || doc_id, 'instance', '<instance src="t' || n || '.tree" version="1.' || n || '" web-path="x>y"/>'
  from (select doc_id, unnest(range(1, doc_id % 3 + 2)) as n from documents)
union all select 'd' || doc_id, 'dirs', 'docs|i|w' from documents
"""

QUERIES = {
    "json_roundtrip": (json_roundtrip, JSON_ROUNDTRIP),
    "module_roundtrip": (module_roundtrip, MODULE_ROUNDTRIP),
    "instance_lookup": (instance_lookup, INSTANCE_LOOKUP),
    "free_instance_ids": (free_instance_ids, FREE_INSTANCE_IDS),
    "tree_xml_pieces": (tree_xml_pieces, TREE_XML_PIECES),
    "tree_xml_text": (tree_xml_text, TREE_XML_TEXT),
    "json_config_pieces": (json_config_pieces, JSON_CONFIG_PIECES),
    "module_xml_pieces": (module_xml_pieces, MODULE_XML_PIECES),
    "topic_stubs": (topic_stubs, TOPIC_STUBS),
    "topic_file_changes": (topic_file_changes, TOPIC_FILE_CHANGES),
    "unique_file_names": (unique_file_names, UNIQUE_FILE_NAMES),
    "unique_instance_ids": (unique_instance_ids, UNIQUE_INSTANCE_IDS),
    "instance_upsert": (instance_upsert, INSTANCE_UPSERT),
    "instance_delete": (instance_delete, INSTANCE_DELETE),
    "instance_create": (instance_create, INSTANCE_CREATE),
    "instance_renames": (instance_renames, INSTANCE_RENAMES),
}
