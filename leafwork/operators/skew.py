"""Window-like operators that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task. Each operator
here first deals the rows out by ranges of (keys, order), so that a slice is what
one range holds of a key: slices have even numbers of rows, however the order values
are spread. It works slice by slice and passes one summary row per slice between
them. The slices are written once, so a recomputed task sees the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwork.session import cut_lineage


def _sliced(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``_slice``: it does not decrease along ``order``, and holds a bounded share of the rows."""
    return cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()))


def split_row_number(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Add ``row_number() over (partition by keys order by order)`` as ``name``.

    ``order`` is unique within a key; keys are not NULL. The rank inside the slice is
    added to the total size of the slices before it.
    """
    slice_keys = [*keys, "_slice"]
    sliced = _sliced(df, keys, [order])
    sizes = sliced.groupBy(*slice_keys).agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *slice_keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    # The window leaves the rows partitioned by the slice keys, as the join needs them.
    ranked = sliced.withColumn(
        name, F.row_number().over(W.partitionBy(*slice_keys).orderBy(order))
    )
    return (
        ranked.join(offsets, slice_keys)
        .withColumn(name, (F.col(name) + F.col("_offset")).cast("long"))
        .drop("_slice", "_offset")
    )


def split_lag(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, str],
    carried: DataFrame | None = None,
) -> DataFrame:
    """Add ``lag(column)`` per key under new names (``values``: name -> column).

    The last row of each slice is found by a partially aggregated ``max_by``; it
    enters the key's next slice as one extra row. ``carried``
    gives the values before a key's first row (columns: keys and the value
    columns), for instance the state left by an earlier batch.
    """
    slice_keys = [*keys, "_slice"]
    columns = sorted(set(values.values()))
    sliced = _sliced(df, keys, order)
    rank = F.struct(*order)
    last = F.max_by(F.struct(*columns), rank)
    ends = sliced.groupBy(*slice_keys).agg(last.alias("_last"))
    entering = ends.select(
        *slice_keys, F.lag("_last").over(W.partitionBy(*keys).orderBy("_slice")).alias("_last")
    )
    if carried is not None:
        initial = carried.select(*keys, F.struct(*columns).alias("_initial"))
        entering = entering.join(initial, keys, "left").select(
            *slice_keys, F.coalesce("_last", "_initial").alias("_last")
        )
    entering = entering.where("_last is not null").select(
        *slice_keys, *[F.col("_last")[c].alias(c) for c in columns], F.lit(False).alias("_real")
    )
    rows = sliced.withColumn("_real", F.lit(True)).unionByName(entering, allowMissingColumns=True)
    within = W.partitionBy(*slice_keys).orderBy("_real", *order)
    for name, column in values.items():
        rows = rows.withColumn(name, F.lag(column).over(within))
    return rows.where("_real").drop("_slice", "_real")


def split_running_max(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str
) -> DataFrame:
    """Add the largest ``value`` so far per key, along ``order``, as ``name``.

    Rows that are equal in keys and order should be merged before; ties stay together.
    """
    slice_keys = [*keys, "_slice"]
    sliced = _sliced(df, keys, order)
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    entering = (
        sliced.groupBy(*slice_keys)
        .agg(F.max(value).alias("_max"))
        .select(*slice_keys, F.max("_max").over(before).alias(value), F.lit(False).alias("_real"))
        .where(F.col(value).isNotNull())
    )
    rows = sliced.withColumn("_real", F.lit(True)).unionByName(entering, allowMissingColumns=True)
    so_far = W.partitionBy(*slice_keys).orderBy("_real", *order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.max(value).over(so_far)).where("_real").drop("_slice", "_real")
