"""Validation of configurations: every violation is a row.

Every object and list of a configuration gets the place it holds in the schema; the
rules are a table of places. A key outside the table is a violation and is not
followed further. All of it happens inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.session import cut_lineage
from leafwork.sources import forest, json_blocks, json_config, xml_config
from leafwork.sources.json_blocks import ORDERS, PLACES


def _get(value: Column, key: str) -> Column:
    """The value under a key, NULL where the key is absent."""
    return F.try_variant_get(value, f"$['{key}']", "variant")


def _items(value: Column) -> Column:
    """The values of a list; none for anything else."""
    return F.coalesce(value.try_cast("array<variant>"), F.array().cast("array<variant>"))


# Stand for a place in what cannot be read, or not as a variant.
_UNREAD, _BEYOND = "parse", "beyond"


def _part(at: Column, place: str | Column, value: Column, level: int = -1, rest: Column | None = None) -> Column:
    return F.struct(
        at.alias("at"), (F.lit(place) if isinstance(place, str) else place).alias("place"), F.lit(level).alias("level"), value.alias("value"),
        (F.lit(None).cast("string") if rest is None else rest).alias("rest"),
    )


def _present(part: Column) -> Column:
    return F.filter(F.array(part), lambda p: p["value"].isNotNull())


def _slash(at: Column, step: Column | str) -> Column:
    return F.concat(at, F.lit("/"), F.lit(step) if isinstance(step, str) else step.cast("string"))


def _toc_parts(tocs: Column, at: Column, level: int, left: int) -> Column:
    """All nodes of the next levels below one list of nodes; the last ones carry the rest."""

    def node(x: Column, i: Column) -> Column:
        here, below = _slash(at, i), _items(_get(x, "children"))
        if left == 0:
            return F.array(_part(here, "toc", x, level, F.when(F.size(below) > 0, F.to_json(below))))
        return F.concat(F.array(_part(here, "toc", x, level)), _toc_parts(below, _slash(here, "children"), level + 1, left - 1))

    return F.flatten(F.transform(tocs, node))


def parts(config: Column) -> Column:
    """Every object of a configuration, with its place in the schema.

    One expression over one value: nothing is shuffled. Nodes deeper than a block of
    levels are left as text with the last node above them.
    """
    listed = _get(config, "instances")

    def instance(x: Column, i: Column) -> Column:
        here = _slash(F.lit("/instances"), i)
        tocs = _toc_parts(
            _items(_get(x, "toc-elements")), _slash(here, "toc-elements"), 0, forest.LEVELS
        )
        return F.concat(F.array(_part(here, "instance", x)), tocs)

    return F.concat(
        F.array(_part(F.lit(""), "root", config)),
        *[_present(_part(F.lit(f"/{key}"), key, _get(config, key))) for key in ("topics", "images")],
        F.flatten(F.transform(_items(listed), instance)),
    )


def _keys_to(*places: str) -> list[str]:
    """``place key`` of every allowed key that leads to one of the places."""
    return [
        f"{place} {key}"
        for place, (kind, inner) in PLACES.items()
        if kind == "object"
        for key, to in inner.items()
        if to in places
    ]


def violations(configs: DataFrame, dialect: str = "J") -> DataFrame:
    """(project_id, instance_path, keyword, detail), all violations of all configurations.

    ``configs``: project_id, content. Text that cannot be parsed, or none at all, is one
    violation (``parse``). Trees deeper than a block of levels are checked in further
    rounds, over what is left of them. JSON that makes no variant is read by its tokens.
    """
    read = json_blocks.parsed(configs)
    none = F.lit(None).cast("variant")
    unread = F.array(_part(F.lit(""), F.when(F.col("beyond"), _BEYOND).otherwise(_UNREAD), none))
    part = read.select("project_id", F.explode(F.when(F.col("c").isNotNull(), parts(F.col("c"))).otherwise(unread)).alias("p"))
    rows = last = cut_lineage(_checked(part.select("project_id", "p.*")))
    while not (open_ := last.where("rest is not null")).isEmpty():
        deeper = _toc_parts(_items(F.try_parse_json("rest")), F.col("instance_path"), 1, forest.LEVELS)
        last = cut_lineage(_checked(open_.select("project_id", F.explode(deeper).alias("p")).select("project_id", "p.*")))
        rows = rows.unionByName(last)
    # Contents are parsed once; those that need another way are looked up by their ids.
    others = rows.where(F.col("keyword") == _BEYOND).select("project_id")
    found = rows.where(F.col("keyword") != _BEYOND).drop("rest")
    if not others.isEmpty():
        texts = configs.join(others, "project_id", "left_semi")
        found = found.unionByName(json_blocks.violations(json_config.as_blocks(texts)))
    return found.withColumn("dialect", F.lit(dialect))


def _checked(part: DataFrame) -> DataFrame:
    """(project_id, instance_path, keyword, detail, rest): a row per violation, and one
    without a keyword for each node whose children are still text."""
    at, place, value = F.col("at"), F.col("place"), F.col("value")

    def row(path: Column, keyword: str, detail: Column) -> Column:
        return F.struct(
            path.alias("instance_path"), F.lit(keyword).alias("keyword"), detail.alias("detail")
        )

    def name(e: Column) -> Column:
        return F.concat(place, F.lit(" "), e["key"])

    def is_text(e: Column) -> Column:
        return F.schema_of_variant(e["value"]) == "STRING"

    def is_order(e: Column) -> Column:
        return is_text(e) & F.try_variant_get(e["value"], "$", "string").isin(*ORDERS)

    def masked(e: Column) -> Column:
        """Titles of top-level nodes that have a topic are replaced before validation."""
        topic = F.coalesce(F.try_variant_get(value, "$.topic", "string"), F.lit(""))
        return (F.col("level") == 0) & (e["key"] == "title") & (topic != "")

    text_keys, order_keys = _keys_to("text"), _keys_to("order")
    list_keys, object_keys = _keys_to("instances", "tocs"), _keys_to("topics", "images")

    def is_bad(e: Column) -> Column:
        return (
            F.when(name(e).isin(*text_keys), ~is_text(e) & ~masked(e))
            .when(name(e).isin(*list_keys), e["value"].try_cast("array<variant>").isNull())
            .when(name(e).isin(*order_keys), ~is_order(e))
            .otherwise(~name(e).isin(*object_keys))
        )

    def rows_of(e: Column) -> Column:
        here, text = _slash(at, e["key"]), F.try_variant_get(e["value"], "$", "string")
        bad_order = row(here, "enum", F.coalesce(text, F.lit("null")))
        return (
            F.when(name(e).isin(*text_keys), F.array(row(here, "type", F.lit("string"))))
            .when(name(e).isin(*list_keys), F.array(row(here, "type", F.lit("array"))))
            .when(name(e).isin(*order_keys) & is_text(e), F.array(bad_order))
            .when(name(e).isin(*order_keys), F.array(row(here, "type", F.lit("string")), bad_order))
            .otherwise(F.array(row(at, "additionalProperties", e["key"])))
        )

    # What is no object has no entries.
    bad = F.filter(F.map_entries(value.try_cast("map<string,variant>")), is_bad)
    inside = F.flatten(F.transform(bad, rows_of))
    unread = F.array(F.struct(at.alias("instance_path"), place.alias("keyword"), F.lit("unreadable").alias("detail")))
    found = F.when(place.isin(_UNREAD, _BEYOND), unread).otherwise(F.coalesce(inside, F.array(row(at, "type", F.lit("object")))))
    listed = F.transform(found, lambda v: v.withField("rest", F.lit(None).cast("string")))
    none = F.lit(None).cast("string")
    more = F.struct(
        _slash(at, "children").alias("instance_path"), none.alias("keyword"), none.alias("detail"), F.col("rest").alias("rest")
    )
    kept = F.concat(listed, F.filter(F.array(more), lambda m: m["rest"].isNotNull()))
    return part.select("project_id", F.explode(kept).alias("v")).select("project_id", "v.*")


def normalised_xml(projects: DataFrame) -> DataFrame:
    """Module configurations in the JSON shape, for the same validation.

    ``projects``: as read from XML. The topics folder has its default; images
    appear only where configured. Trees need no check: their attributes are text.
    """
    images = F.struct(
        F.col("images_dir").alias("dir"),
        F.col("images_version").alias("version"),
        F.col("images_web_path").alias("web-path"),
    )
    any_image = F.coalesce("images_dir", "images_version", "images_web_path").isNotNull()
    config = F.struct(
        F.struct(F.coalesce("topics_dir", F.lit("topics")).alias("dir")).alias("topics"),
        F.when(any_image, images).alias("images"),
        F.array().cast("array<string>").alias("instances"),
    )
    return projects.select("project_id", F.to_json(config).alias("content"))


def xml_violations(configs: DataFrame, readable: DataFrame) -> DataFrame:
    """Violations of module configurations: (project_id, instance_path, keyword, detail, dialect).

    ``configs``: project_id, content; ``readable``: as the XML reader tells. What cannot be
    read, null included, is one violation (``parse``).
    """
    text = F.lit("").alias("instance_path"), F.lit("parse").alias("keyword"), F.lit("unreadable").alias("detail")
    unread = readable.where("not readable").select("project_id", *text, F.lit("X").alias("dialect"))
    read = configs.join(readable.where("readable"), "project_id", "left_semi")
    return violations(normalised_xml(xml_config.projects(read)), "X").unionByName(unread)


def accepted(configs: DataFrame, found: DataFrame) -> DataFrame:
    """Configurations without a violation."""
    return configs.join(found.select("project_id").distinct(), "project_id", "left_anti")
