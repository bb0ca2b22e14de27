"""Centroid clustering of whole-number vectors by tables of squared differences.

In each round a task tabulates, for every dimension, the squared difference between each
value that occurs in a block of vectors and each centroid; a vector's distances are then
sums of table rows that its values point at. Tasks return one row of exact sums for each
centroid, which Spark adds up, so the driver sees as many rows as there are centroids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import stored

LARGEST = 1 << 27  # distances of up to 64 such components fit a long
_BLOCK = 8192
ASSIGNED = "vec_id long, cluster int, distance long"


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """``vec_id, vector``: the rows with ``dims`` finite components, each as floor(scale * x).

    A component whose whole value is ``LARGEST`` or more is an error: its distances would
    not fit a long.
    """
    values = F.col(vector_col).cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.where((F.coalesce(F.size(values), F.lit(-1)) == dims) & F.coalesce(finite, F.lit(False)))

    def whole(x):
        scaled = F.floor(F.when(F.abs(x * scale) < LARGEST, x * scale)).cast("int")
        return F.coalesce(scaled, F.raise_error(F.lit("component too large for exact distances")).cast("int"))

    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(values, whole).alias("vector"))


def nearest(block: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of, and squared distance to, the nearest centroid; ties go to the smaller number."""
    total = np.zeros((len(block), len(centroids)), np.int64)
    for d in range(centroids.shape[1]):
        occurring, at = np.unique(block[:, d], return_inverse=True)
        table = np.square(occurring[:, None] - centroids[None, :, d])
        total += table[at]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(block)), cluster]


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _BLOCK):
            part = batch.slice(at, _BLOCK)
            yield part, part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _totals(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster, n, total``: exact sums over the vectors nearest to each centroid."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, block in _blocks(batches, dims):
            cluster, _ = nearest(block, centroids)
            order = np.argsort(cluster, kind="stable")
            met, first = np.unique(cluster[order], return_index=True)
            count[met] += np.diff([*first, len(block)])
            total[met] += np.add.reduceat(block[order], first, axis=0)
        met = np.flatnonzero(count)
        if len(met):
            yield pa.RecordBatch.from_pydict({"cluster": met, "n": count[met], "total": list(total[met])})

    parts = vectors.mapInArrow(add, "cluster long, n long, total array<long>")
    sums = F.array(*(F.sum(F.col("total")[d]) for d in range(dims)))
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), sums.alias("total"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of ``seed:vec_id``; vectors break ties."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.orderBy(mark, "vector").select("vector").limit(k).collect()
    return np.array([r["vector"] for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` for each row of ``whole_vectors()``, and the final centroids.

    Each round moves every centroid that has vectors to the floor of their mean. Fewer
    vectors than ``k`` give as many centroids as there are vectors; no vectors give an
    empty table. Rows that repeat an id, and rows without one, count like all others;
    a null id is hashed as empty text.
    """
    vectors = stored(vectors.select("vec_id", "vector"), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        moved = centroids.copy()
        for row in _totals(vectors, centroids).collect():  # one row for each centroid
            moved[row["cluster"]] = [s // row["n"] for s in row["total"]]
        centroids = moved
    dims = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in _blocks(batches, dims):
            at, distance = nearest(block, centroids)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(at.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"]
            )

    return vectors.mapInArrow(assign, ASSIGNED), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` to each row of ``cluster()``."""
    assigned = stored(assigned, "assigned")
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    by_cluster = F.array(*(F.lit(sums.get(c, 0)).cast("long") for c in range(max(1, len(centroids)))))
    texts = F.array(F.lit(""), *(F.lit(",".join(map(str, row))) for row in centroids.tolist()))
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        by_cluster[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        F.sha2(texts[F.col("cluster") + 1].cast("binary"), 256).alias("centroid_sha256"),
    )
