"""The shared scratch folder, and the one way lineage is cut."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The reliable folder for checkpoints and intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset
    a folder of the default file system is used; that is the local one just where Spark
    itself runs locally.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master or "").startswith("local"):
            store = sc._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
            if store.startswith("file:"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = f"{store.rstrip('/')}/tmp/leafwork"
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="leafwork-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a DataFrame in the reliable folder: it outlives its executors."""
    scratch_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """While this holds, scans are dealt out for files of some kilobytes.

    Spark takes opening a file for as much as reading 4 MB, and lists each folder in a task
    of its own: a few files a task. Scans are dealt out when they run, so run them within.
    """
    held = {
        "spark.sql.files.openCostInBytes": 64 << 10,
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": 4 * spark.sparkContext.defaultParallelism,
    }
    before = {key: spark.conf.get(key) for key in held}
    for key, value in held.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
