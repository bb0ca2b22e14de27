"""Following changes: latest configurations, changed titles, current topics, reloads.

Each operator has a batch form over a table of changes and a streaming form whose state
Spark keeps. Ordered work of the batch forms is cut into slices, so that a file saved
all the time does not end up in one task. Streams hold events until the watermark has
passed them and apply them in order of time, so that a late delivery does not
overwrite a newer one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafwork.functions import text as X
from leafwork.operators.skew import split_lag
from leafwork.streaming.ordered import Changes

ORDER = ["ts", "seq"]
FILE = ["project_id", "file"]


def latest_changes(changes: DataFrame) -> DataFrame:
    """Last change per (project_id, path) and whether the file exists after it.

    ``changes``: project_id, path, kind, ts, seq, content; a deletion is a row too.
    """
    last = F.max_by(F.struct("kind", "content", *ORDER), F.struct(*ORDER))
    return changes.groupBy("project_id", "path").agg(last.alias("_c")).select(
        "project_id", "path", "_c.*", (F.col("_c.kind") != "delete").alias("exists")
    )


def title_changes(saves: DataFrame, remembered: DataFrame | None = None) -> DataFrame:
    """Saves whose title differs from the one saved before for the same file.

    ``saves``: project_id, file, ts, seq, content; a blank file is passed over.
    ``remembered``: project_id, file, title of earlier saves.
    """
    titled = saves.withColumn("title", X.saved_title(F.col("content"))).where("title is not null")
    seen = split_lag(
        titled.select(*FILE, *ORDER, "title"), FILE, ORDER, {"before": "title"}, remembered
    )
    return seen.where("before is null or before != title").drop("before")


def rename_edits(changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rename edits for changed titles of files that a tree holds.

    Titles that were taken out give no edit. A file in several trees is renamed in
    each of them.
    """
    places = nodes.select("project_id", "instance_id", F.col("topic").alias("file")).distinct()
    return changed.where("title != ''").join(places, FILE).select(
        "project_id",
        "instance_id",
        "seq",
        F.lit("rename").alias("op"),
        F.col("file").alias("topic"),
        F.lit(None).cast("string").alias("target"),
        "title",
        F.lit(None).cast("string").alias("file_name"),
    )


def current_topics(opened: DataFrame, remembered: DataFrame | None = None) -> DataFrame:
    """Steps of a session from one file to another, with the title then shown.

    ``opened``: session, file, ts, seq, content; files without a heading do not
    count, and a title is taken only when the file changes.
    """
    titled = opened.withColumn("title", X.live_title(F.col("content"), F.col("file"))).where("title is not null")
    seen = split_lag(
        titled.select("session", "file", *ORDER, "title"), ["session"], ORDER, {"before": "file"}, remembered
    )
    return seen.where("before is null or before != file").drop("before")


# Streams -------------------------------------------------------------------

# Large states live in RocksDB, on the executors' disks; ordered events need it.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _started(stream: DataFrame, mode: str, step: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return (
        stream.writeStream.foreachBatch(step)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _written(folder: str) -> Callable[[DataFrame, int], None]:
    """Write a batch's rows to a folder of its own: a batch that runs again replaces them."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")


def without_repeats(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Drop deliveries of one change that arrive again within ``delay``.

    Sources that deliver at least once need it; the watermark bounds what is kept.
    """
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


_SLOTS = 2  # a snapshot being read is not the next one to be written


def follow_changes(stream: DataFrame, folder: str, every: int = 16, **trigger) -> StreamingQuery:
    """Keep the latest change per file; read it with :func:`latest_state`.

    The state is one row per file. Repeated and late deliveries change nothing: the
    largest time and number wins, whenever it comes. After each ``every`` batches what they
    wrote is merged into a snapshot, in one of two folders in turn, and then marked as
    valid; a batch that runs again writes the same files, snapshot and mark once more.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], "upto long, slot long").write.mode("append").parquet(f"{folder}/marks")

    def step(batch: DataFrame, batch_id: int) -> None:
        _written(folder)(batch, batch_id)
        if batch_id % every == every - 1:
            session = batch.sparkSession
            slot = batch_id // every % _SLOTS
            merged = _latest(_since_snapshot(session, folder, batch_id))
            merged.repartition("project_id", "path").write.mode("overwrite").parquet(f"{folder}/snapshots/slot={slot}")
            mark = session.range(1).selectExpr(f"{batch_id}L as upto", f"{slot}L as slot")
            mark.coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/upto_{batch_id}")

    return _started(latest_changes(stream), "update", step, f"{folder}/checkpoint", **trigger)


def _since_snapshot(spark, folder: str, before: int | None = None) -> DataFrame:
    """Rows of the last valid snapshot (of those before a batch) and of the batches after it.

    Batches are folders, so those that the snapshot holds are not read.
    """
    marks = spark.read.option("recursiveFileLookup", "true").schema("upto long, slot long").parquet(f"{folder}/marks")
    mark = (marks if before is None else marks.where(F.col("upto") < before)).agg(F.max(F.struct("upto", "slot")).alias("m")).first()["m"]
    rows = spark.read.parquet(f"{folder}/out").where(F.col("batch") > (mark["upto"] if mark else -1))
    if before is not None:
        rows = rows.where(F.col("batch") <= before)
    if not mark:
        return rows
    snapshot = spark.read.parquet(f"{folder}/snapshots/slot={mark['slot']}")
    return snapshot.withColumn("batch", F.lit(mark["upto"]).cast("int")).unionByName(rows.withColumn("batch", F.col("batch").cast("int")))


def _latest(rows: DataFrame) -> DataFrame:
    values = [c for c in rows.columns if c not in ("project_id", "path", "batch")]
    last = F.max_by(F.struct(*values), "batch").alias("_v")
    return rows.groupBy("project_id", "path").agg(last).select("project_id", "path", "_v.*")


def latest_state(spark, folder: str) -> DataFrame:
    """Latest change per file, as far as the batches written: a snapshot and what came after it."""
    return _latest(_since_snapshot(spark, folder))


# Events of a busy key wait in buckets of this much time.
BUCKET = 3_600_000_000


def _ordered(titled: DataFrame, keys: list[str], compared: str, delay: str) -> DataFrame:
    """Rows whose ``compared`` differs from the row before in time, per key."""
    timed = titled.withColumn("ts", F.col("ts").cast("timestamp"))
    once = without_repeats(timed, [*keys, "seq"], delay).withColumn("at", F.unix_micros("ts"))
    columns = [*keys, *([] if "file" in keys else ["file"]), "at", "seq", "title"]
    schema = once.select(*columns).schema
    changed = once.select("ts", *columns).groupBy(*keys).transformWithStateInPandas(
        Changes(columns, schema, compared, BUCKET), schema, outputMode="Append", timeMode="EventTime"
    )
    ts = F.timestamp_micros("at").cast(titled.schema["ts"].dataType)
    return changed.withColumn("ts", ts).select(*[c if c != "at" else "ts" for c in columns])


def title_stream(saves: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The streaming form of :func:`title_changes`; ``delay`` is how late a save may come."""
    titled = saves.withColumn("title", X.saved_title(F.col("content"))).where("title is not null")
    return _ordered(titled.drop("content"), FILE, "title", delay)


def session_stream(opened: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The streaming form of :func:`current_topics`."""
    titled = opened.withColumn("title", X.live_title(F.col("content"), F.col("file"))).where("title is not null")
    return _ordered(titled.drop("content"), ["session"], "file", delay)


def follow_titles(stream: DataFrame, folder: str, delay: str = "10 minutes", **trigger) -> StreamingQuery:
    """Write changed titles to ``folder/out``, one folder per batch."""
    return _started(title_stream(stream, delay), "append", _written(folder), f"{folder}/checkpoint", **trigger)


def follow_sessions(stream: DataFrame, folder: str, delay: str = "10 minutes", **trigger) -> StreamingQuery:
    """Write the steps of sessions between files to ``folder/out``."""
    return _started(session_stream(stream, delay), "append", _written(folder), f"{folder}/checkpoint", **trigger)


def follow_reloads(
    stream: DataFrame,
    folder: str,
    reload: Callable[[DataFrame, DataFrame], DataFrame],
    **trigger,
) -> StreamingQuery:
    """Reload the projects that a batch of changes touches, and only those.

    ``reload`` gets the changed files' latest versions (project_id, path, kind, content,
    ts, seq, exists) and the touched projects (project_id), and returns what to write to
    ``folder/out``, with a ``project_id``. It reads other files of these projects where they
    are stored. Read the result with :func:`reloaded`: each batch is a version of the projects
    it touches, so a project that a reload gives no rows for is gone.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        # Written first: the reload may read it many times.
        changed = f"{folder}/changed/batch={batch_id}"
        batch.write.mode("overwrite").parquet(changed)
        latest = batch.sparkSession.read.schema(batch.schema).parquet(changed)
        _written(folder)(reload(latest, latest.select("project_id").distinct()), batch_id)

    return _started(latest_changes(stream), "update", step, f"{folder}/checkpoint", **trigger)


def reloaded(spark, folder: str) -> DataFrame:
    """The rows of every project's last version, as far as the batches written.

    The changes of a batch name the projects it touched, those without rows included.
    """
    touched = spark.read.parquet(f"{folder}/changed")
    versions = touched.groupBy("project_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{folder}/out").join(versions, ["project_id", "batch"]).drop("batch")
