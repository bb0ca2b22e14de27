"""Files under names of their own, as a corpus of small files needs them.

Spark's writers name files themselves, and open, commit and list a folder for each. Here
the tasks write the files, so nothing about a file passes through the driver.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(rows: DataFrame, folder: str) -> None:
    """Write ``rows`` (path, content) as files at ``path`` below ``folder``.

    A file is a row's content and a line end, as Spark's text files are (NULL: the line end
    alone). Rows of one path share a file. Contents are written where they lie, under names
    that no reader sees; then only names are dealt out, and each file gets its own. Tasks may
    run again or twice. ``folder`` is one that pyarrow reaches from every executor: local,
    HDFS or an object store.
    """

    def store_of(folder: str) -> tuple[fs.FileSystem, str]:
        # Within, as tasks then need not import this module.
        local = re.match(r"file:/*(/.*)", folder)
        if local or folder.startswith("/"):
            return fs.LocalFileSystem(), local[1] if local else folder
        return fs.FileSystem.from_uri(folder)

    staged = f".staged-{uuid.uuid4().hex}"

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        home, n = f"{staged}/{uuid.uuid4().hex}", 0
        store.create_dir(f"{root}/{home}", recursive=True)
        for batch in batches:
            parts = []
            for content in batch.column("content"):
                parts.append(f"{home}/{n}")
                n += 1
                with store.open_output_stream(f"{root}/{parts[-1]}") as out:
                    out.write(content.as_buffer() or b"")
                    out.write(b"\n")
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(parts, pa.string())], names=["path", "part"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        pairs = (pair for batch in batches for pair in zip(batch.column("path").to_pylist(), batch.column("part").to_pylist(), strict=True))
        made, n = None, 0
        for path, same in groupby(pairs, key=itemgetter(0)):
            home = f"{root}/{path}".rpartition("/")[0]
            if home != made:
                store.create_dir(home, recursive=True)
                made = home
            first, *others = [f"{root}/{part}" for _, part in same]
            if others:
                # Parts stay, so that a task which runs again finds them.
                whole = f"{first}-{uuid.uuid4().hex}"
                with store.open_output_stream(whole) as out:
                    for part in (first, *others):
                        with store.open_input_stream(part) as read:
                            while block := read.read(1 << 20):
                                out.write(block)
                first = whole
            try:
                store.move(first, f"{root}/{path}")
            except FileNotFoundError:  # an earlier run of the task has moved it
                if store.get_file_info(f"{root}/{path}").type != fs.FileType.File:
                    raise
            n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    parts = rows.select("path", F.col("content").cast("binary")).mapInArrow(stage, "path string, part string")
    # Names are small, and would be coalesced into few tasks.
    spark = rows.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts.repartition(tasks, "path").sortWithinPartitions("path").mapInArrow(name, "n long").agg(F.sum("n")).collect()
    store, root = store_of(folder)
    if store.get_file_info(f"{root}/{staged}").type == fs.FileType.Directory:
        store.delete_dir(f"{root}/{staged}")
