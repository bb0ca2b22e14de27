"""Changes to topic files, as new versions of the topics table.

Keys decide; contents only travel with their row. Where the topics table is kept
bucketed by project and file, the joins below move no content at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.functions import text as X

FILE = ["project_id", "file"]


def new_stubs(requests: DataFrame, topics: DataFrame) -> DataFrame:
    """Stub contents for requested topics that do not exist yet.

    ``requests``: project_id, file, title, seq; the first request for a file counts.
    """
    first = requests.groupBy(*FILE).agg(F.min_by("title", "seq").alias("title"))
    return first.join(topics.select(*FILE), FILE, "left_anti").select(
        *FILE, X.stub(F.col("title")).alias("content")
    )


def create_results(requests: DataFrame, topics: DataFrame) -> DataFrame:
    """Each request with ``created``: false where the file exists already."""
    first = requests.groupBy(*FILE).agg(F.min("seq").alias("seq"))
    made = first.join(topics.select(*FILE), FILE, "left_anti").withColumn("created", F.lit(True))
    return requests.join(made, [*FILE, "seq"], "left").withColumn("created", F.coalesce("created", F.lit(False)))


def delete_files(topics: DataFrame, deleted: DataFrame) -> DataFrame:
    """Topics without the deleted ones; deleting a missing file is no error."""
    return topics.join(deleted.select(*FILE), FILE, "left_anti")


def rename_files(topics: DataFrame, renames: DataFrame) -> DataFrame:
    """Topics under their new names. ``renames``: project_id, file, new_file, seq.

    A name in use is not overwritten, and of several files that want one name the
    first gets it.
    """
    names = topics.select(*FILE)
    granted = (
        renames.join(names, FILE, "left_semi")
        .join(names.withColumnRenamed("file", "new_file"), ["project_id", "new_file"], "left_anti")
        .groupBy("project_id", "new_file")
        .agg(F.min_by("file", "seq").alias("file"))
    )
    return (
        topics.join(granted, FILE, "left")
        .withColumn("file", F.coalesce("new_file", "file"))
        .drop("new_file")
    )
