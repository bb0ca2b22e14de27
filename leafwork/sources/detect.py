"""Which dialect a project uses, and what a new project starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The configuration a new project gets.
DEFAULT_CONFIG = {
    "schema": "https://json-schema.org/draft/2020-12/schema",
    "type": "object",
    "topics_dir": "topics",
    "images_dir": "images",
    "images_version": "1.0",
    "images_web_path": "images",
}
DEFAULT_MODULE = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<ihp version="2.0">\n  <topics dir="topics"/>\n</ihp>'
)


def detect_projects(json_configs: DataFrame, xml_configs: DataFrame, violations: DataFrame) -> DataFrame:
    """(project_id, dialect, config_code) for every project with a configuration.

    The configurations: project_id, readable. The JSON one is tried first. If it
    can be read but is invalid the project is refused (code 0); if it cannot be
    read the XML one is tried. Codes: 2 JSON, 1 XML, 0 neither. ``violations``
    carries ``dialect``.
    """
    both = json_configs.select("project_id", "readable", F.lit("J").alias("dialect")).unionByName(
        xml_configs.select("project_id", "readable", F.lit("X").alias("dialect"))
    )
    bad = violations.select("project_id", "dialect").distinct().withColumn("invalid", F.lit(True))
    state = (
        both.join(bad, ["project_id", "dialect"], "left")
        .withColumn("valid", F.col("invalid").isNull())
        .groupBy("project_id")
        .agg(
            F.bool_or((F.col("dialect") == "J") & F.col("readable")).alias("j_read"),
            F.bool_or((F.col("dialect") == "J") & F.col("readable") & F.col("valid")).alias("j_ok"),
            F.bool_or((F.col("dialect") == "X") & F.col("readable") & F.col("valid")).alias("x_ok"),
        )
    )
    code = F.when(F.col("j_ok"), 2).when(F.col("j_read"), 0).when(F.col("x_ok"), 1).otherwise(0)
    return state.select("project_id", code.alias("config_code")).select(
        "project_id",
        F.when(F.col("config_code") == 2, "J").when(F.col("config_code") == 1, "X").alias("dialect"),
        "config_code",
    )


def default_configs(wanted: DataFrame, existing: DataFrame, title: str) -> DataFrame:
    """JSON configurations for the wanted projects that have none yet."""
    d = DEFAULT_CONFIG
    config = F.struct(
        F.lit(d["schema"]).alias("schema"),
        F.lit(title).alias("title"),
        F.lit(d["type"]).alias("type"),
        F.struct(F.lit(d["topics_dir"]).alias("dir")).alias("topics"),
        F.struct(
            F.lit(d["images_dir"]).alias("dir"),
            F.lit(d["images_version"]).alias("version"),
            F.lit(d["images_web_path"]).alias("web-path"),
        ).alias("images"),
        F.array().cast("array<string>").alias("instances"),
    )
    new = wanted.select("project_id").distinct().join(existing.select("project_id"), "project_id", "left_anti")
    return new.select("project_id", F.to_json(config).alias("content"))


def default_modules(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """XML module configurations for the wanted projects that have none yet."""
    new = wanted.select("project_id").distinct().join(existing.select("project_id"), "project_id", "left_anti")
    return new.select("project_id", F.lit(DEFAULT_MODULE).alias("content"))
