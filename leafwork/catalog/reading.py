"""Registered queries: titles, names and image references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.catalog import inputs as I
from leafwork.functions import images as M
from leafwork.functions import paths as P
from leafwork.functions import text as X
from leafwork.operators import lookup


def topic_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tree node with the title of its topic file."""
    nodes = lookup.with_titles(I.toc(spark, sf_dir), I.topics(spark, sf_dir))
    return nodes.select(
        "project_id", "instance_id", P.path_key(F.col("node_path")).alias("path"), "topic", "title"
    )


TOPIC_TITLES = f"""
with recursive {I.sql_toc()}, {I.sql_topics()}
select t.project_id, t.instance_id, t.path, t.topic,
  case when t.dialect = 'X' or t.depth = 0
       then coalesce({I.sql_title('f.content', 'f.file')}, '<' || t.topic || '>')
       else 'old ' || t.doc_id end as title
from toc t left join topics f on f.project_id = t.project_id and f.file = t.topic
"""


def set_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every topic with its heading replaced, as length and digest of the new text."""
    new = X.set_title(F.col("content"), F.concat(F.lit("New "), "file"))
    return (
        I.all_topics(spark, sf_dir)
        .withColumn("changed", new)
        .select("file", F.length("changed").alias("n_chars"), F.md5("changed").alias("digest"))
    )


SET_TITLE = rf"""
with {I.sql_all_topics()}, split_up as (
  select *, regexp_extract(content, '\A\s*# [^\n]*', 0) as head from topics),
changed as (
  select file, case when regexp_extract(content, '\A\s*# [ \t]*[^\s]', 0) <> ''
    then regexp_extract(head, '\A(?:\s*\n)?', 0) || '# New ' || file || substr(content, length(head) + 1)
    else '# New ' || file || chr(10) || content end as changed from split_up)
select file, length(changed) as n_chars, md5(changed) as digest from changed
"""


def live_saved_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as shown while a topic is open and as compared on save."""
    return I.all_topics(spark, sf_dir).select(
        "file",
        X.live_title(F.col("content"), F.col("file")).alias("live_title"),
        X.saved_title(F.col("content")).alias("saved_title"),
    )


LIVE_SAVED_TITLES = rf"""
with {I.sql_all_topics()}, lines as (
  select *, trim(regexp_extract(content, '\A\s*([^\s][^\n]*)', 1), ' ' || chr(9) || chr(13)) as line from topics)
select file,
  case when starts_with(line, '#') and not starts_with(line, '##')
       then coalesce(nullif(trim(substr(line, 2), ' ' || chr(9) || chr(13)), ''), file) end as live_title,
  case when line = '' then null when starts_with(line, '# ')
       then trim(substr(line, 2), ' ' || chr(9) || chr(13)) else '' end as saved_title
from lines
"""


def file_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names and first-topic titles for part names used as titles."""
    title = F.concat(F.lit("  "), "p_name", F.lit("  "), "p_type", F.lit("\t"), "p_partkey")
    return I.table(spark, sf_dir, "part").select(
        "p_partkey",
        X.slug(title).alias("slug"),
        X.start_page_file(title).alias("start_page"),
        X.about_title(title).alias("about"),
        X.numbered_file(F.col("p_name"), F.col("p_size")).alias("numbered"),
    )


FILE_SLUGS = r"""
with t as (select *, '  ' || p_name || '  ' || p_type || chr(9) || p_partkey as title from part)
select p_partkey,
  regexp_replace(lower(trim(title)), '\s+', '-', 'g') || '.md' as slug,
  regexp_replace(lower(title), '\s+', '-', 'g') || '.md' as start_page,
  'About ' || title as about,
  regexp_replace(lower(p_name), '\s+', '-', 'g') || p_size || '.md' as numbered
from t
"""


def instance_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default ids for conversation texts used as titles (their initials)."""
    return I.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.default_instance_id(F.col("text")).alias("instance_id")
    )


INSTANCE_IDS = r"""
select conv_id, turn,
  array_to_string(list_transform(string_split_regex(text, '\s+'), lambda w: lower(left(w, 1))), '') as instance_id
from conversations
"""


def project_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics and images folders per project, with the defaults where none is set."""
    configured = I.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "concat('/work/', c_mktsegment, '/project.config.json') as config_path",
        "case c_custkey % 4 when 0 then '' when 1 then null when 2 then lower(c_name) else 'a/../docs' end as topics_dir",
        "case c_custkey % 3 when 0 then '' when 1 then null else './img' end as images_dir",
    )
    home = X.dir_name(F.col("config_path"))
    return configured.select(
        "c_custkey",
        P.posix_join(home, F.coalesce(X.non_empty(F.col("topics_dir")), F.lit(X.DEFAULT_TOPICS_DIR))).alias("topics_path"),
        P.posix_join(home, F.coalesce(X.non_empty(F.col("images_dir")), F.lit(X.DEFAULT_IMAGES_DIR))).alias("images_path"),
    )


PROJECT_DIRS = """
select c_custkey,
  '/work/' || c_mktsegment || '/' ||
    case c_custkey % 4 when 2 then lower(c_name) when 3 then 'docs' else 'topics' end as topics_path,
  '/work/' || c_mktsegment || '/' || case when c_custkey % 3 = 2 then 'img' else 'images' end as images_path
from customer
"""


def instance_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instance names and start pages with their defaults."""
    given = I.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "case when c_custkey % 2 = 0 then c_name when c_custkey % 3 = 0 then '' end as name",
        "case when c_custkey % 5 = 0 then '' else concat('id', c_custkey) end as id",
        "case when c_custkey % 7 = 0 then concat(c_mktsegment, '.md') end as start_page",
    )
    return given.select(
        "c_custkey",
        X.instance_name(F.col("name"), F.col("id")).alias("name"),
        F.coalesce("start_page", F.lit("")).alias("start_page"),
    )


INSTANCE_NAMES = """
select c_custkey,
  case when c_custkey % 2 = 0 then c_name when c_custkey % 5 = 0 then 'Untitled' else 'id' || c_custkey end as name,
  case when c_custkey % 7 = 0 then c_mktsegment || '.md' else '' end as start_page
from customer
"""


# Tags of every kind in front of each page, and what becomes of them in a topics folder.
_TAGS = (
    "<img src='s.png'><IMG SRC=\"u.png\"><img data-src=\"l.png\" src=\"m.png\"><img alt=\"x\" src=\"../images/r.png\">"
    "<img src=\"HTTPS://h/x.png\"><img src=\"httpfoo.png\"><img src=\"../up.png\">"
)
_TAGS_MOVED = (
    "<img src='../images/s.png'><img SRC=\"../images/u.png\"><img data-src=\"l.png\" src=\"../images/m.png\"><img alt=\"x\" src=\"../images/r.png\">"
    "<img src=\"HTTPS://h/x.png\"><img src=\"../images/httpfoo.png\"><img src=\"../up.png\">"
)


def html_image_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image tags of whole pages in a topics folder pointed at the images folder."""
    html = F.concat(F.lit(_TAGS), F.replace(F.col("html"), F.lit("<a href="), F.lit("<img src=")))
    path = F.expr("concat(if(page_id % 3 = 0, '/w/media/', '/w/topics/'), page_id, '.html')")
    rewritten = F.when(M.in_topics_folder(path, F.lit("topics")), M.rewrite_html_images(html, F.lit("images"))).otherwise(html)
    return (
        I.table(spark, sf_dir, "pages")
        .withColumn("rewritten", rewritten)
        .select("page_id", F.length("rewritten").alias("n_chars"), F.md5("rewritten").alias("digest"))
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


# Link targets in the pages start with a slash or a scheme, which RE2 can tell apart.
HTML_IMAGE_REWRITE = rf"""
with p as (select page_id, replace(html, '<a href=', '<img src=') as html from pages),
r as (select page_id, case when page_id % 3 = 0 then {_quoted(_TAGS)} || html
  else {_quoted(_TAGS_MOVED)} || regexp_replace(html, '<img src="/([^"]*)"', '<img src="../images/\1"', 'g') end as rewritten from p)
select page_id, length(rewritten) as n_chars, md5(rewritten) as digest from r
"""

# What takes the place of each line end of a document, and what becomes of it: images
# that must change, images on the web or in place, and images in code or escaped.
_MARKS = (
    " ![a](./img/p.png) ![w](https://h/x.png) ![r](../images/r.png \"t\") `![c](c.png)` \\![e](e.png) ![p](p(1).png \"t\")"
    " ![g][R] ![k]\n\n    ![i](i.png)\n\n~~~\n```\n![f](f.png)\n~~~\n\n[r]: d.png\n[k]: ./k.png\n[link]: l.png\n\n"
    "![n [o [p]] \\]](n.png) [![in](in.png)](l.png) ![d](d((1)).png)\n\n> ```\n> ![q](q.png)\n> ```\n> ![qq](qq.png)\n\n"
    "- ~~~\n  ![l](l.png)\n  ~~~\n  ![ll](ll.png)\n\n"
)
_MARKS_MOVED = (
    " ![a](../images/img/p.png) ![w](https://h/x.png) ![r](../images/r.png \"t\") `![c](c.png)` \\![e](e.png) ![p](../images/p(1).png \"t\")"
    " ![g][R] ![k]\n\n    ![i](i.png)\n\n~~~\n```\n![f](f.png)\n~~~\n\n[r]: ../images/d.png\n[k]: ../images/k.png\n[link]: l.png\n\n"
    "![n [o [p]] \\]](../images/n.png) [![in](../images/in.png)](l.png) ![d](../images/d((1)).png)\n\n> ```\n> ![q](q.png)\n> ```\n> ![qq](../images/qq.png)\n\n"
    "- ~~~\n  ![l](l.png)\n  ~~~\n  ![ll](../images/ll.png)\n\n"
)


def md_image_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown images of whole documents in a topics folder pointed at the images folder."""
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(_MARKS))
    path = F.expr("concat(if(doc_id % 4 = 0, '/w/media/', '/w/topics/'), doc_id, '.md')")
    rewritten = F.when(M.in_topics_folder(path, F.lit("topics")), M.rewrite_markdown_images(text, F.lit("images"))).otherwise(text)
    return (
        I.documents(spark, sf_dir)
        .withColumn("rewritten", rewritten)
        .select("doc_id", F.length("rewritten").alias("n_chars"), F.md5("rewritten").alias("digest"))
    )


MD_IMAGE_REWRITE = f"""
with r as (select doc_id, replace(text, chr(10), case when doc_id % 4 = 0 then {_quoted(_MARKS)} else {_quoted(_MARKS_MOVED)} end) as rewritten from documents)
select doc_id, length(rewritten) as n_chars, md5(rewritten) as digest from r
"""

QUERIES = {
    "topic_titles": (topic_titles, TOPIC_TITLES),
    "set_title": (set_title, SET_TITLE),
    "live_saved_titles": (live_saved_titles, LIVE_SAVED_TITLES),
    "file_slugs": (file_slugs, FILE_SLUGS),
    "instance_ids": (instance_ids, INSTANCE_IDS),
    "project_dirs": (project_dirs, PROJECT_DIRS),
    "instance_names": (instance_names, INSTANCE_NAMES),
    "html_image_rewrite": (html_image_rewrite, HTML_IMAGE_REWRITE),
    "md_image_rewrite": (md_image_rewrite, MD_IMAGE_REWRITE),
}
