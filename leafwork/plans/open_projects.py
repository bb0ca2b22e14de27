"""From configuration, tree and topic files to project, instance and node tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.operators import lookup, validate
from leafwork.session import cut_lineage
from leafwork.sources import detect, json_config, xml_config


class Opened(NamedTuple):
    projects: DataFrame
    instances: DataFrame
    nodes: DataFrame
    violations: DataFrame


def open_projects(
    json_configs: DataFrame,
    xml_configs: DataFrame,
    trees: DataFrame,
    topics: DataFrame,
) -> Opened:
    """Detect, validate and load every project, with the titles of its topics.

    ``json_configs``, ``xml_configs``: project_id, content; ``trees``: path, content
    (below the project's folder); ``topics``: project_id, file, and content or title. Projects
    that are refused have a row in ``projects`` with code 0 and nothing else.
    """
    j_projects, x_projects = json_config.projects(json_configs), xml_config.projects(xml_configs)
    readable_xml = cut_lineage(xml_config.readability(xml_configs))
    violations = validate.violations(json_configs).unionByName(validate.xml_violations(xml_configs, readable_xml))
    # One short row per project, used to pick the inputs of every table below.
    codes = cut_lineage(
        detect.detect_projects(json_config.readability(json_configs), readable_xml, violations)
    )
    settings = j_projects.unionByName(x_projects)
    projects = codes.join(settings, ["project_id", "dialect"], "left")

    chosen = codes.where("dialect is not null").select("project_id", "dialect")
    # What is joined are rows made in the scans; contents stay where they are.
    of = lambda rows, dialect: rows.join(chosen.where(f"dialect = '{dialect}'"), "project_id", "left_semi")
    x_instances = xml_config.load_instances(of(xml_config.registry(xml_configs), "X"), trees)
    instances = of(json_config.instances(json_configs), "J").unionByName(x_instances)

    homes = x_instances.select("project_id", F.col("tree_path").alias("path"))
    x_nodes = xml_config.nodes(trees).join(homes, "path").select(
        "project_id",
        "instance_id",
        "node_path",
        "topic",
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("map<string,string>").alias("more"),
        F.lit("X").alias("dialect"),
    )
    nodes = lookup.with_titles(of(json_config.nodes(json_configs), "J").unionByName(x_nodes), topics)
    return Opened(projects, instances, nodes, violations)
