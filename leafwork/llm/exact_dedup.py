"""Exact de-duplication of whole texts that survives very large groups of copies.

Equal texts are combined three times, each time on the digest *and* the full
content: inside each task (the partial aggregate), in salted groups (the salt is the
task's number, so a group held by every task goes to ``salts`` reducers), and
globally over the salts' winners. Every task and every salt passes on one row per
text, so no reducer sees more rows of a group than there are tasks or salts.

Ids go back to the documents by a narrow join on the digest. Only groups of two and
more take part, and they are dealt out in ``salts`` copies, so that a text which a
third of all rows share is joined in as many places. Digests that stand for several
contents are told apart by joining those rows, and only those, on content too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """A text with every run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _contents(rows: DataFrame, salts: int) -> DataFrame:
    """One row per digest and content: smallest id, number of rows."""
    salted = rows.groupBy("_digest", "_text", (F.spark_partition_id() % salts).alias("_salt")).agg(
        F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_n")
    )
    return salted.groupBy("_digest", "_text").agg(F.min("_id").alias("_keep"), F.sum("_n").alias("_size"))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = _sha256,
) -> DataFrame:
    """For each row: ``doc_id, keep_id, group_size, kept, digest``.

    ``keep_id`` is the smallest id among the rows with an equal normalised text.
    Null and empty texts are equal to each other. A null id is never the one that
    stays, unless all ids of its group are null. Rows that repeat an id and text are
    counted and are all marked as kept if their id stays: they are one document. An
    empty table gives no rows; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"))
    rows = rows.withColumn("_digest", digest(F.col("_text")))
    groups = stored(
        _contents(rows, salts)
        .groupBy("_digest")
        .agg(F.count(F.lit(1)).alias("_contents"), F.min("_keep").alias("_keep"), F.max("_size").alias("_size"))
        .where("_contents > 1 or _size > 1"),
        "exact-groups",
    )
    plain = groups.where("_contents = 1").select(
        "_digest", "_keep", "_size", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    ).hint("merge")  # Spark would judge its size by the rows before the explode
    narrow = rows.select("_id", "_digest", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("_salt"))
    clashing = groups.where("_contents > 1").select("_digest")
    if clashing.isEmpty():
        return _result(narrow.join(plain, ["_digest", "_salt"], "left"))
    out = narrow.join(clashing, "_digest", "left_anti").join(plain, ["_digest", "_salt"], "left")
    clashed = rows.join(clashing, "_digest", "left_semi")
    by_content = clashed.join(_contents(clashed, salts), ["_digest", "_text"])
    return _result(out).unionByName(_result(by_content))


def _result(rows: DataFrame) -> DataFrame:
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return rows.select(
        F.col("_id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.col("_digest").alias("digest"),
    )
