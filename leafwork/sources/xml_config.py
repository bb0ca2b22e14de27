"""XML module configurations and tree files to project, instance and node tables.

Every attribute is read as text: identifiers such as ``007`` keep their zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.functions import text as X
from leafwork.functions.arrays import bind, running_totals
from leafwork.functions.images import rewrite_matches
from leafwork.functions.paths import posix_join
from leafwork.sources import forest

_OPTIONS = {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"}
_STRING = T.StringType()


def _attributes(*names: str) -> T.StructType:
    return T.StructType([T.StructField(f"_{n}", _STRING) for n in names])


_MODULE = T.StructType(
    [
        T.StructField("topics", _attributes("dir")),
        T.StructField("images", _attributes("dir", "version", "web-path")),
        T.StructField("instance", T.ArrayType(_attributes("src", "version"))),
    ]
)


def has_root(content: Column, tag: str) -> Column:
    """True where the document element is ``tag``; what precedes it is passed over."""
    return F.regexp_like(
        content, F.lit(rf"\A(?:[\s\x{{FEFF}}]|<\?[\s\S]*?\?>|<!--[\s\S]*?-->|<![A-Za-z][^>]*>)*+<{tag}[\s/>]")
    )


def _parsed(configs: DataFrame) -> DataFrame:
    """Module configurations; any other document element gives an empty one."""
    content = F.when(has_root(F.col("content"), "ihp"), F.col("content"))
    return configs.withColumn("m", F.from_xml(content, _MODULE, _OPTIONS))


def readability(configs: DataFrame) -> DataFrame:
    """(project_id, readable): false where the content is no well-formed XML, or there is none.

    The XML reader decides; it reads one element and passes over what follows it.
    """
    unread = F.from_xml("content", "unread string", {**_OPTIONS, "columnNameOfCorruptRecord": "unread"})["unread"]
    return configs.select("project_id", (F.col("content").isNotNull() & unread.isNull()).alias("readable"))


def projects(configs: DataFrame) -> DataFrame:
    """Folders as configured. ``configs``: project_id, content."""
    return _parsed(configs).select(
        "project_id",
        F.lit("X").alias("dialect"),
        X.non_empty(F.col("m.topics._dir")).alias("topics_dir"),
        X.non_empty(F.col("m.images._dir")).alias("images_dir"),
        F.col("m.images._version").alias("images_version"),
        F.col("m.images.`_web-path`").alias("images_web_path"),
        F.lit(None).cast("map<string,string>").alias("more"),
    )


def registry(configs: DataFrame) -> DataFrame:
    """Registered instances in order: none, one or many give as many rows."""
    return _parsed(configs).select("project_id", F.posexplode("m.instance").alias("ordinal", "i")).select(
        "project_id",
        "ordinal",
        F.col("i._src").alias("src"),
        F.col("i._version").alias("version"),
    )


def _below(levels: int) -> T.StructType:
    """Nodes to some depth; the XML reader gives what is inside a deeper one as text."""
    leaf = [T.StructField("toc-element", T.ArrayType(_STRING))]
    return T.StructType([T.StructField("toc-element", T.ArrayType(forest.node_schema(["_topic"], "toc-element", levels, leaf)))])


_BELOW, _ABOVE = _below(forest.LEVELS), _below(forest.LEVELS - 1)
_HEAD = _attributes("id", "name", "start-page")


_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
_ROOT = r"(?s)\A(.*?<ihp)(" + _ATTRIBUTES + r")(?:/>\s*\z|>(.*)</ihp\s*>.*\z)"
# A comment, a section of plain characters, an instruction, a tag, or text.
_TOKEN = r"<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[\s\S]*?\?>|<(?![!?])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^<]++|<"


def _pieces(inner: Column) -> Column:
    """What an element holds, as it is written: its child elements, comments, instructions and texts.

    A running depth over the tags tells where a child ends, so children may hold elements
    of their own name. White space between them is no piece.
    """

    def step(token: Column) -> Column:
        plain = ~F.startswith(token, F.lit("<")) | F.startswith(token, F.lit("<!")) | F.startswith(token, F.lit("<?"))
        return F.when(plain | F.endswith(token, F.lit("/>")), 0).when(F.startswith(token, F.lit("</")), -1).otherwise(1)

    def cut(tokens: Column) -> Column:
        def at_depths(depths: Column) -> Column:
            places = F.sequence(F.lit(1), F.size(tokens))
            ends = F.filter(places, lambda k: (F.element_at(depths, k) <= 0) | (k == F.size(tokens)))
            return bind(ends, joined)

        def joined(ends: Column) -> Column:
            starts = F.concat(F.array(F.lit(0)), ends)
            return F.transform(
                ends, lambda e, k: F.array_join(F.slice(tokens, starts[k] + 1, e - starts[k]), "")
            )

        depths = bind(F.transform(tokens, step), running_totals)
        return F.when(F.size(tokens) > 0, bind(depths, at_depths)).otherwise(F.array().cast("array<string>"))

    found = bind(F.regexp_extract_all(inner, F.lit(_TOKEN), F.lit(0)), cut)
    trimmed = F.transform(found, lambda p: F.regexp_replace(p, r"\A[ \t\r\n]+|[ \t\r\n]+\z", ""))
    return F.filter(trimmed, lambda p: p != "")


def elements(configs: DataFrame) -> DataFrame:
    """Everything a module configuration holds, as it is written: project_id, ordinal, tag, text.

    Row -1 has the root's attributes as its text and what precedes the root as its tag; the
    others are the root's child elements, comments, instructions and texts (tag NULL).
    """
    whole = configs.where(has_root(F.col("content"), "ihp"))
    inner = F.regexp_extract("content", _ROOT, 3)
    root = whole.select(
        "project_id", F.lit(-1).alias("ordinal"), F.regexp_extract("content", _ROOT, 1).alias("tag"),
        F.trim(F.regexp_replace(F.regexp_extract("content", _ROOT, 2), "/$", "")).alias("text"),
    )
    parts = whole.select("project_id", F.posexplode(_pieces(inner)).alias("ordinal", "text"))
    tag = F.nullif(F.regexp_extract("text", r"\A<([^\s<>/!?][^\s<>/]*)", 1), F.lit(""))
    return root.select("project_id", "ordinal", "tag", "text").unionByName(parts.withColumn("tag", tag))


def written_registry(configs: DataFrame) -> DataFrame:
    """The registry with each entry's ``text`` as it is written, all its attributes included."""
    whole = configs.where(has_root(F.col("content"), "ihp"))
    entries = F.filter(_pieces(F.regexp_extract("content", _ROOT, 3)), lambda e: F.regexp_like(e, F.lit(r"\A<instance[\s/>]")))
    texts = whole.select("project_id", F.posexplode(entries).alias("ordinal", "text"))
    return registry(configs).join(texts, ["project_id", "ordinal"])


def _profiles(trees: DataFrame, schema: T.StructType) -> DataFrame:
    p = F.from_xml("content", schema, _OPTIONS)
    # An element without attributes and children counts as no profile.
    empty = F.regexp_like("content", F.lit(r"<instance-profile\s*(?:/>|>\s*</instance-profile\s*>)"))
    return trees.where(has_root(F.col("content"), "instance-profile") & ~empty).withColumn("p", p)


def load_instances(reg: DataFrame, trees: DataFrame) -> DataFrame:
    """Instances of the registered entries that have a readable tree file.

    ``reg``: project_id, ordinal, src; ``trees``: path, content. Entries without a
    source, without a file or without a profile are dropped.
    """
    entries = reg.where("src != ''").withColumn("path", posix_join(F.col("project_id"), F.col("src")))
    # Only the head of each file crosses the network here.
    heads = _profiles(trees, _HEAD).select(
        "path", F.col("p._id").alias("id"), F.col("p._name").alias("name"), F.col("p.`_start-page`").alias("page")
    )
    return entries.join(heads, "path").select(
        "project_id",
        F.col("id").alias("instance_id"),
        X.instance_name(F.col("name"), F.col("id")).alias("name"),
        F.coalesce("page", F.lit("")).alias("start_page"),
        F.col("path").alias("tree_path"),
        "ordinal",
    )


# Stands for an ampersand where escapes must outlast a reading.
_AMPERSAND = "\ue000\ue001"


def _kept(content: Column) -> Column:
    """Content of which the reader gives texts with their escapes, so that they can be read again."""
    escaped = rewrite_matches(content, r"=\s*'[^'<]*'", lambda m: F.replace(m, F.lit('"'), F.lit("&quot;")))
    return F.replace(escaped, F.lit("&"), F.lit(_AMPERSAND))


def _flat(content: Column, siblings: Column, prefix: Column) -> Column:
    """The nodes of the first levels of ``siblings``, read from ``content``.

    Where a node of the last level has children, the content is read once more, one
    level less deep, so that these nodes' insides come as text.
    """
    deep = lambda x: F.when(F.size(x["toc-element"]) > 0, F.lit(""))
    nodes = forest.flatten(siblings, prefix, {"topic": "_topic"}, "toc-element", forest.LEVELS, deep)
    inside = forest.leaves(F.from_xml(_kept(content), _ABOVE, _OPTIONS)["toc-element"], prefix, "toc-element", forest.LEVELS - 1)
    text = lambda found: F.replace(F.element_at(found, 1)["text"], F.lit(_AMPERSAND), F.lit("&"))
    found = lambda n, texts: text(F.filter(texts, lambda t: t["node_path"] == n["node_path"]))
    with_rest = lambda texts: F.transform(nodes, lambda n: n.withField("rest", F.when(n["rest"].isNotNull(), found(n, texts))))
    return F.when(
        F.exists(nodes, lambda n: n["rest"].isNotNull()), F.element_at(F.transform(F.array(inside), with_rest), 1)
    ).otherwise(nodes)


def nodes(trees: DataFrame) -> DataFrame:
    """Nodes of tree files: path, instance_id, node_path, topic. ``trees``: path, content."""
    root = F.array().cast("array<int>")
    profiles = _profiles(trees, T.StructType([*_HEAD.fields, *_BELOW.fields]))
    flat = _flat(F.col("content"), F.col("p.`toc-element`"), root)
    first = profiles.select("path", F.col("p._id").alias("instance_id"), F.explode(flat).alias("n")).select("path", "instance_id", "n.*")

    def deeper(rest: Column, path: Column) -> Column:
        wrapped = F.concat(F.lit("<r>"), rest, F.lit("</r>"))
        return _flat(wrapped, F.from_xml(wrapped, _BELOW, _OPTIONS)["toc-element"], path)

    return forest.unfold(first, ["path", "instance_id"], deeper)


def tree_ids(trees: DataFrame) -> DataFrame:
    """(path, instance_id) of the tree files that have a profile."""
    return _profiles(trees, _HEAD).select("path", F.col("p._id").alias("instance_id"))
