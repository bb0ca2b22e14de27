"""What the operators of this subpackage share: stored tables, hashed samples, word hashes."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.session import scratch_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it: computed once, kept if executors go."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Stands for a null id inside tasks, where a column with nulls would turn into floats.
NO_ID = -(1 << 63)


def known_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def restored(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """Null ids again, after the tasks."""
    return df.withColumn(name, F.nullif(F.col(name), F.lit(NO_ID)))


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of an id's decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def hashed_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of ``key``; all rows of smaller tables."""
    total = df.count()
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < int(1_000_003 * rows / total))


def word_hashes(words: list) -> np.ndarray:
    """64-bit hashes of words (str or bytes), the same in every process."""
    if not words:
        return np.empty(0, np.uint64)
    values = np.empty(len(words), object)
    values[:] = words
    return pd.util.hash_array(values, categorize=False)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order; none if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for k in range(size):
        out = (out ^ words[k : k + n]) * factor
        out ^= out >> np.uint64(29)
    return out
