"""Streams in several batches give what the batch form gives at once."""

from pyspark.sql import functions as F

from leafwork.streaming import changes as S

SCHEMA = "project_id string, file string, path string, session string, ts timestamp, seq bigint, kind string, content string"


def feed(spark, folder, batch_of="seq div 60"):
    rows = spark.range(240).selectExpr(
        "'p' as project_id", "concat('f', if(id % 3 = 0, 0, id % 5), '.md') as file", "concat('c', id % 4) as path",
        "concat('s', id % 2) as session", "timestamp_seconds(1700000000 + id * 400) as ts", "id as seq",
        "if(id % 11 = 0, 'delete', 'change') as kind",
        "case when id % 7 = 0 then '' when id % 6 = 0 then 'plain' else concat('# T', id div 8) end as content",
    )
    # Four files; each is one batch.
    for i in range(4):
        rows.where(f"{batch_of} = {i}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return rows


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_streams_equal_batches(spark, tmp_path):
    rows = feed(spark, tmp_path)
    titles = f"{tmp_path}/titles"
    S.follow_titles(stream(spark, tmp_path), titles, delay="0 seconds").awaitTermination()
    want = S.title_changes(rows)
    assert as_set(spark.read.parquet(f"{titles}/out").select(*want.columns)) == as_set(want)
    assert len(spark.read.parquet(f"{titles}/out").select("batch").distinct().collect()) > 1

    sessions = f"{tmp_path}/sessions"
    S.follow_sessions(stream(spark, tmp_path), sessions, delay="0 seconds").awaitTermination()
    want = S.current_topics(rows)
    assert as_set(spark.read.parquet(f"{sessions}/out").select(*want.columns)) == as_set(want)

    latest = f"{tmp_path}/latest"
    S.follow_changes(stream(spark, tmp_path), latest).awaitTermination()
    want = S.latest_changes(rows)
    assert as_set(S.latest_state(spark, latest).select(*want.columns)) == as_set(want)


def test_late_and_repeated_deliveries_change_nothing(spark, tmp_path):
    rows = feed(spark, tmp_path, "pmod(xxhash64(seq), 4)")
    # Every row arrives a second time, and one far later row lets the watermark pass.
    spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    end = rows.limit(1).selectExpr(
        "'end' as project_id", "file", "path", "'end' as session", "ts + interval 90 days as ts", "10000L as seq", "kind", "'# End' as content"
    )
    end.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    titles = f"{tmp_path}/titles"
    S.follow_titles(stream(spark, tmp_path), titles, delay="30 days").awaitTermination()
    want = S.title_changes(rows)
    got = spark.read.parquet(f"{titles}/out").where("project_id != 'end'")
    assert got.count() == want.count() and as_set(got.select(*want.columns)) == as_set(want)

    sessions = f"{tmp_path}/sessions"
    S.follow_sessions(stream(spark, tmp_path), sessions, delay="30 days").awaitTermination()
    want = S.current_topics(rows)
    got = spark.read.parquet(f"{sessions}/out").where("session != 'end'")
    assert got.count() == want.count() and as_set(got.select(*want.columns)) == as_set(want)

    latest = f"{tmp_path}/latest"
    S.follow_changes(stream(spark, tmp_path), latest).awaitTermination()
    want = S.latest_changes(rows)
    assert as_set(S.latest_state(spark, latest).where("project_id != 'end'").select(*want.columns)) == as_set(want)


def test_reload_sees_the_latest_files_of_touched_projects(spark, tmp_path):
    rows = feed(spark, tmp_path)
    folder = f"{tmp_path}/reload"
    S.follow_reloads(stream(spark, tmp_path), folder, lambda latest, touched: latest.join(touched, "project_id")).awaitTermination()
    last = spark.read.parquet(f"{folder}/out").where("batch = 3").drop("batch")
    want = S.latest_changes(rows)
    assert as_set(last.select(*want.columns)) == as_set(want)


def test_deleted_configurations_take_their_projects_out(spark, tmp_path):
    steps = [
        [("a", "change", "1"), ("b", "change", "1"), ("c", "change", "1")],
        [("a", "delete", None), ("b", "change", "2")],
        [("c", "delete", None), ("a", "change", "3")],
    ]
    seq, folder = 0, f"{tmp_path}/reload"
    for i, step in enumerate(steps):
        rows = []
        for project, kind, content in step:
            rows.append((project, "x", "project.json", "s", seq, kind, content))
            seq += 1
        df = spark.createDataFrame(rows, "project_id string, file string, path string, session string, seq long, kind string, content string")
        df.withColumn("ts", F.timestamp_seconds("seq")).select("project_id", "file", "path", "session", "ts", "seq", "kind", "content").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = S.follow_reloads(stream(spark, tmp_path), folder, lambda latest, touched: latest.where("exists").select("project_id", "content"))
        query.awaitTermination()
        got = as_set(S.reloaded(spark, folder))
        assert got == [{("a", "1"), ("b", "1"), ("c", "1")}, {("b", "2"), ("c", "1")}, {("a", "3"), ("b", "2")}][i]


def test_latest_state_reads_a_snapshot_and_what_came_after(spark, tmp_path):
    rows = feed(spark, tmp_path, "seq div 60")
    many = f"{tmp_path}/many"
    for i in range(50):
        rows.where(f"seq div 5 = {i}").coalesce(1).write.mode("append").parquet(f"{many}/in")
    latest = f"{tmp_path}/latest"
    S.follow_changes(stream(spark, many), latest, every=8).awaitTermination()
    got = S.latest_state(spark, latest)
    want = S.latest_changes(rows)
    assert as_set(got.select(*want.columns)) == as_set(want)
    read = [r.f for r in S._since_snapshot(spark, latest).select(F.input_file_name().alias("f")).distinct().collect()]
    batches = {f.split("batch=")[1].split("/")[0] for f in read if "batch=" in f}
    assert batches <= {"48", "49"} and len({f.split("slot=")[1][0] for f in read if "slot=" in f}) == 1
    # A batch that runs again, with its snapshot, changes nothing.
    before = as_set(got)
    assert as_set(S._latest(S._since_snapshot(spark, latest, 47))) <= as_set(S.latest_changes(rows.where("seq < 240")))
    assert as_set(S.latest_state(spark, latest)) == before


def test_a_busy_key_waits_in_buckets(spark, tmp_path, monkeypatch):
    """Lists hold few events, buckets the others; the rows stay the same."""
    monkeypatch.setattr(S, "BUCKET", 7_200_000_000)
    rows = spark.range(9000).selectExpr(
        "'p' as project_id", "concat('f', id % 3, '.md') as file", "'c' as path", "if(id % 3 = 0, 's', concat('t', id % 50)) as session",
        "timestamp_seconds(1700000000 + (id * 7919) % 9000 * 60) as ts", "id as seq", "'change' as kind", "concat('# T', id % 4) as content",
    )
    for i in range(3):
        rows.where(f"seq div 3000 = {i}").coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
    sessions = f"{tmp_path}/sessions"
    S.follow_sessions(stream(spark, tmp_path), sessions, delay="30 days").awaitTermination()
    end = rows.limit(1).selectExpr("project_id", "file", "path", "'end' as session", "ts + interval 90 days as ts", "100000L as seq", "kind", "content")
    end.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    S.follow_sessions(stream(spark, tmp_path), sessions, delay="30 days").awaitTermination()
    want = S.current_topics(rows)
    assert as_set(spark.read.parquet(f"{sessions}/out").where("session != 'end'").select(*want.columns)) == as_set(want)


def test_repeated_deliveries_are_dropped(spark, tmp_path):
    feed(spark, tmp_path)
    # Every file arrives a second time.
    spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    once = S.without_repeats(stream(spark, tmp_path), ["project_id", "seq"], "2 days")
    query = once.select("seq").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").agg(F.count("*"), F.countDistinct("seq")).first()[0] == 240
