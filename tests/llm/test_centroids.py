"""Clustering by lookup tables against plain integer arithmetic."""

import hashlib
import math
import random

import pytest

from leafwork.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance double, n int, total string, vector int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 0.5, 2, "t", 3) for i, v in rows], SCHEMA)


def brute(rows, k, rounds, dims):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    means = [v for _, v in sorted(good, key=mark)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(means))

    for _ in range(rounds):
        groups = {}
        for _, v in good:
            groups.setdefault(nearest(v)[1], []).append(v)
        means = [[sum(col) // len(groups[c]) for col in zip(*groups[c], strict=True)] if c in groups else m for c, m in enumerate(means)]
    out = [(i, *nearest(v)[::-1]) for i, v in good]
    inertia = {c: sum(d for _, x, d in out if x == c) for c in range(len(means))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(((i or -1, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in out))


@pytest.mark.parametrize("dims, k", [(3, 4), (64, 7), (5, 100)])
def test_equals_plain_arithmetic(spark, dims, k):
    rng = random.Random(dims)
    rows = [(i, [rng.choice((-1, 0, 1)) + rng.random() / 64 for _ in range(dims)]) for i in range(60)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (70, [0.0] * dims), (71, [0.0] * dims)]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    odd = [(80, None), (81, []), (82, [0.0] * (dims + 1)), (83, [None] + [0.0] * (dims - 1)), (84, [float("nan")] * dims), (85, [float("inf")] + [0.0] * (dims - 1))]
    df = frame(spark, rows + odd)
    stored = [(r["vec_id"], r["embedding"]) for r in df.collect()]  # as floats
    got = centroids.with_inertia(*centroids.cluster(centroids.whole_vectors(df, dims=dims), k, 4))
    assert sorted((r["vec_id"] or -1, *tuple(r)[1:]) for r in got.collect()) == brute(stored, k, 4, dims)


def test_no_vectors(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        got = centroids.with_inertia(*centroids.cluster(centroids.whole_vectors(frame(spark, rows))))
        assert got.count() == 0
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_that_fit_no_long_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.whole_vectors(frame(spark, [(1, [1e30, 0.0])]), dims=2).collect()
