"""Time the headline queries: one JSON line on standard output.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and ``BENCH_CPUS`` choose data
and cores; ``BENCH_QUERIES=all`` or a comma-separated list chooses queries.
"""

from __future__ import annotations

import glob
import json
import os
import re
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from leafwork.catalog.registry import REGISTRY

HEADLINE = [
    "topic_titles", "set_title", "instance_ids", "html_image_rewrite", "md_image_rewrite",
    "toc_flatten", "toc_subtree_size", "toc_parent", "toc_first_match", "missing_topics",
    "toc_add", "toc_rename", "json_config_flatten", "tree_xml_flatten", "config_violations",
    "tree_xml_pieces", "unique_file_names", "instance_upsert", "change_latest", "title_changes",
    "toc_move", "edit_batch", "opened_projects", "title_changes_stream", "json_roundtrip",
]


def split_inputs(spark: SparkSession, sf_dir: str, files: int) -> str:
    """A copy of the tables in ``files`` parts each: a single small file is read by one task.

    Large tables have many files; the small ones here have one, so this makes them alike.
    """
    folder = tempfile.mkdtemp(prefix="leafwork-bench-")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        spark.read.parquet(path).repartition(files).write.parquet(f"{folder}/{os.path.basename(path)}")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("leafwork-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    sf_dir = split_inputs(spark, sf_dir, int(cpus))
    # Start the JVM's compilers on one query before anything is timed.
    REGISTRY["topic_titles"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
