"""File scans: configurations, tree files and topics, one row per file.

File names are a matter of the corpus, so every reader takes a glob. A project is
the folder that holds its configuration.

Spark's scans list on the driver and set up a reader for each file, which takes longer
than a small file does. Where there are many files on a mounted file system, tasks list
and open them. Other stores, and few files, are left to Spark's scans.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions import text as X
from leafwork.functions.paths import posix_join
from leafwork.session import cut_lineage

_FEW = 1_000  # files that Spark's scans open
# Names that Spark's text scans unpack.
_PACKED = r"[.](?:deflate|gz|bz2|lz4|snappy|zst|passthrough)\z"


def _mounted(spark: SparkSession, glob: str) -> tuple[str, list[str]] | None:
    """The folder and the steps below it, from the first with a star on; None if Spark is to expand the glob."""
    local = re.match(r"file:/*(/.*)", glob)
    store = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    if not local and not (glob.startswith("/") and store.startswith("file:")):
        return None
    steps = [step for step in (local[1] if local else glob).split("/") if step]
    first = next((k for k, step in enumerate(steps) if "*" in step), None)
    if first is None or re.search(r"[\\{}\[\]?]", glob) or {".", ".."} & {*steps}:
        return None
    return "/" + "/".join(steps[:first]), steps[first:]


def in_tasks(spark: SparkSession, glob: str) -> bool:
    """Whether tasks list a glob's files, and the driver holds none of them."""
    return _mounted(spark, glob) is not None


def _dealt(spark: SparkSession) -> int:
    """Tasks for names that stand for files: their own size says little."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _found(spark: SparkSession, folder: str, steps: list[str]) -> DataFrame:
    """(path, address) of the files that Spark's listing of ``folder``/``steps`` would have.

    One task lists the folder, the others what is below.
    """

    def below(home: str, step: str) -> list[str]:
        # Within, as tasks then need not import this module.
        if "*" not in step:
            return [f"{home}/{step}"] if os.path.exists(f"{home}/{step}") else []
        named = re.compile(".*".join(map(re.escape, step.split("*"))), re.DOTALL)
        return [f"{home}/{name}" for name in os.listdir(home) if named.fullmatch(name)] if os.path.isdir(home) else []

    def filled(path: str) -> bool:
        try:
            return os.stat(path).st_size > 0
        except FileNotFoundError:  # a link to nothing
            return False

    def shown(name: str) -> bool:
        hidden = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
        return not hidden or name.startswith(("_common_metadata", "_metadata"))

    def inside(home: str) -> Iterator[os.DirEntry]:
        with os.scandir(home) as entries:
            for entry in entries:
                if not shown(entry.name):
                    continue
                if not entry.is_dir():
                    yield entry
                elif "=" in entry.name:  # a partition
                    yield from inside(entry.path)

    def batches_of(paths: Iterator[str]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for path in paths:
            held.append(path)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_pydict({"path": pa.array(held, pa.string())})
                held = []
        yield pa.RecordBatch.from_pydict({"path": pa.array(held, pa.string())})

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from batches_of(path for _ in range(batch.num_rows) for path in below(folder.rstrip("/"), steps[0]))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[str]:
            for batch in batches:
                for begun in batch.column("path").to_pylist():
                    paths = [begun]
                    for step in steps[1:]:
                        paths = [path for home in paths for path in below(home, step)]
                    for path in paths:
                        if os.path.isdir(path):
                            yield from (entry.path for entry in inside(path) if filled(entry.path))
                        elif shown(path.rpartition("/")[2]) and filled(path):
                            yield path

        yield from batches_of(found())

    begun = spark.range(1, numPartitions=1).mapInArrow(top, "path string").repartition(_dealt(spark), "path")
    return begun.mapInArrow(rest, "path string").select("path", F.concat(F.lit("file:"), "path").alias("address"))


def _opened(listed: DataFrame) -> DataFrame | None:
    """``listed`` (address, ...) with ``content``, each file opened once, in tasks; None if Spark is to open them.

    A task holds a batch of some megabytes, or one file, at a time.
    """
    own, packed = F.col("address").startswith("file:/"), F.regexp_like("address", F.lit(_PACKED))
    kinds = listed.agg(F.count(F.lit(1)), F.bool_and(own & ~packed)).first()
    if kinds[0] <= _FEW or not kinds[1]:
        return None
    names, content = listed.columns, "content"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, text = None, b""
        for batch in batches:
            start, held, size = 0, [], 0
            for n, address in enumerate(batch.column("address").to_pylist(), 1):
                if address != last:
                    with open(address.removeprefix("file:"), "rb") as file:
                        last, text = address, file.read()
                held.append(text)
                size += len(text)
                if size >= 4 << 20 or n == batch.num_rows:
                    part = batch.slice(start, n - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*names, content])
                    start, held, size = n, [], 0

    kept = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in listed.schema.fields)
    dealt = listed.repartition(_dealt(listed.sparkSession), "address").sortWithinPartitions("address")
    return dealt.mapInArrow(read, f"{kept}, content binary").withColumn(content, F.col(content).cast("string"))


def read_files(spark: SparkSession, glob: str | list[str]) -> DataFrame:
    """(path, content) of every file of a glob, or of several.

    Paths are plain: ``scheme://store/dir/x`` is ``/store/dir/x``, so that joining
    and comparing them works the same on every file system.
    """
    if isinstance(glob, str) and _mounted(spark, glob):
        opened = _opened(list_files(spark, glob))
        if opened is not None:
            return opened.select("path", "content")
    return _scanned(spark, glob)


def _scanned(spark: SparkSession, glob: str | list[str]) -> DataFrame:
    """The same, by Spark's scan."""
    # Escapes are undone; a plus sign is no escape in a file's address.
    address = F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))
    return spark.read.text(glob, wholetext=True).select(
        F.regexp_replace(F.url_decode(address), r"\A[A-Za-z][A-Za-z0-9+.-]*:/*", "/").alias("path"),
        F.col("value").alias("content"),
    )


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, address) of every file, without reading any: a few tasks for each core do."""
    if place := _mounted(spark, glob):
        found = cut_lineage(_found(spark, *place))
        if not found.isEmpty():  # else Spark tells an absent place from an empty one
            return found
    address = F.col("path")
    plain = F.regexp_replace(address, r"\A[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    found = spark.read.format("binaryFile").load(glob).select(plain.alias("path"), address.alias("address"))
    return found.coalesce(4 * spark.sparkContext.defaultParallelism)


def read_listed(spark: SparkSession, files: DataFrame, batch: int = 50_000) -> DataFrame:
    """(path, content) of the files at ``address``, and of no others.

    Of what tasks do not open, the driver holds ``batch`` addresses at a time, and Spark's
    plan a scan for each batch.
    """
    plain = F.regexp_replace("address", r"\A[A-Za-z][A-Za-z0-9+.-]*:/*", "/").alias("path")
    opened = _opened(files.select(plain, "address"))
    if opened is not None:
        return opened.select("path", "content")
    scans, held = [], []
    for row in files.select("address").toLocalIterator(prefetchPartitions=True):
        held.append(re.sub(r"([\\{}\[\]*?,])", r"\\\1", row["address"]))
        if len(held) == batch:
            scans, held = [*scans, _scanned(spark, held)], []
    if held or not scans:
        none = spark.createDataFrame([], "path string, content string")
        scans.append(_scanned(spark, held) if held else none)
    return reduce(DataFrame.unionByName, scans)


def read_json_configs(spark: SparkSession, glob: str) -> DataFrame:
    """(project_id, path, content) of JSON configurations."""
    return read_files(spark, glob).select(X.dir_name(F.col("path")).alias("project_id"), "path", "content")


read_xml_configs = read_json_configs


def read_tree_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, content) of instance tree files."""
    return read_files(spark, glob)


def _owners(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, project_id, file): a topic belongs to the project whose topics folder is one
    of its parent folders; ``file`` is the path below it."""
    folder = posix_join(
        F.col("project_id"), F.coalesce(X.non_empty(F.col("topics_dir")), F.lit(X.DEFAULT_TOPICS_DIR))
    )
    homes = projects.select("project_id", F.rtrim(folder, F.lit("/")).alias("folder"))
    # Folders above a file, as an equi-join key.
    steps = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(2), F.size(steps) - 1),
        lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"),
    )
    return (
        paths.withColumn("folder", F.explode(above))
        .join(homes, "folder")
        .withColumn("file", F.substring("path", F.length("folder") + 2, F.length("path")))
        .drop("folder")
    )


def read_titles(spark: SparkSession, glob: str, projects: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Titles of the projects' topics: (project_id, file, title), NULL where there is no heading.

    One scan; only paths and titles leave it. ``projects``: project_id, topics_dir (as
    configured, or NULL). With ``named`` (project_id, file), as a tree names its topics, the
    folders are listed first, and files that no tree names are not opened.
    """
    if named is not None:
        # No name is kept for the listing: the driver holds its files only until it is cut.
        chosen = cut_lineage(
            _owners(list_files(spark, glob), projects).join(named, ["project_id", "file"], "left_semi").select("project_id", "file", "path", "address")
        )
        title = X.heading(F.col("content")).alias("title")
        opened = _opened(chosen)
        if opened is not None:
            return opened.select("project_id", "file", title)
        titled = read_listed(spark, chosen.select("address").distinct()).select("path", title)
        return chosen.join(titled, "path").select("project_id", "file", "title")
    titled = read_files(spark, glob).select("path", X.heading(F.col("content")).alias("title"))
    return _owners(titled, projects).select("project_id", "file", "title")


def read_topics(spark: SparkSession, glob: str, projects: DataFrame) -> DataFrame:
    """Topics of the projects with their contents: (project_id, file, content).

    For what writes contents; titles alone are read by :func:`read_titles`.
    """
    # Owners are found from a listing, which the driver need not hold while files are read;
    # files are opened once, for what they hold.
    owned = cut_lineage(_owners(list_files(spark, glob), projects))
    opened = _opened(owned)
    if opened is None:
        opened = owned.select("path", "project_id", "file").join(_scanned(spark, glob), "path")
    return opened.select("project_id", "file", "content")
