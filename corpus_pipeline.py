"""Training-data pipeline: five stages from raw documents to packed ones.

Each stage takes the documents its predecessor kept, with all their columns, and
returns those it keeps; ``run`` writes every result as Parquet to the shared scratch
folder and reads it for the next stage. Documents may hold nulls in any column, empty
or very long texts and repeated rows. Every stage decides row by row: rows that share an
id, and rows without one, get numbers of their own for the stage, so that none is kept or
dropped for another's text. An empty table passes through as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import decontaminate, exact_dedup, minhash, packing, quality
from leafwork.llm.common import crc_of_id, stored, table

CONTEXT = 2048
SIMILAR = 80  # percent of the union that near copies share
MARGIN = 0.135  # five standard deviations of an estimate there
# No stage can be written in SQL as a whole; the tests hold run() against brute force.
ORACLE_SQL = None


def _numbered(docs: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` with a number for each row in ``_row``, and which numbers are ids.

    A row's number is its ``doc_id``, where no other row has it; other rows, and those
    without an id, get numbers above all ids, which are written, so that they stay.
    """
    if "_row" in docs.columns:
        raise ValueError("documents hold a column _row, which the stages need")
    ids = docs.select(F.col("doc_id").cast("long").alias("_id"))
    clashing = ids.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 or _id is null").select("_id")
    if clashing.isEmpty():
        return docs.withColumn("_row", F.col("doc_id").cast("long")), F.lit(True)
    most = ids.agg(F.max("_id").alias("m")).first()["m"] or 0
    own = F.when(F.col("_clash").isNull(), F.col("doc_id").cast("long")).otherwise(F.monotonically_increasing_id() + (most + 1))
    marked = docs.join(clashing.withColumn("_clash", F.lit(True)), docs["doc_id"].cast("long").eqNullSafe(F.col("_id")), "left")
    return stored(marked.withColumn("_row", own).select(*docs.columns, "_row"), "numbered"), F.col("doc_id") <= most


def _without(numbered: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """The rows of ``numbered`` but those in ``dropped`` (one column), which is written first."""
    rows = stored(dropped.toDF("_dropped").distinct(), name)
    return numbered.join(rows, numbered["_row"] == rows["_dropped"], "left_anti").drop("_row")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Labels are learned for ids of one row."""
    numbered, is_id = _numbered(docs)
    stats = quality.stored_statistics(numbered, "_row")
    labels = table(spark, sf_dir, "labels").where(crc_of_id(F.col("doc_id")) % 5 != 0)
    scored = quality.score(stats, quality.train(stats.where(is_id), labels))
    return _without(numbered, scored.where("predicted = 0").select("doc_id"), "rejected")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the smallest id that is its own."""
    numbered, _ = _numbered(docs)
    groups = exact_dedup.exact_groups(numbered, "_row")
    return _without(numbered, groups.where("not kept").select("doc_id"), "copies")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: the one with the smallest id that is its own."""
    numbered, _ = _numbered(docs)
    near = minhash.near_duplicates(numbered, "_row", percent=SIMILAR, margin=MARGIN)
    return _without(numbered, near.where("not kept").select("doc_id"), "near-copies")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    numbered, _ = _numbered(docs)
    hits = decontaminate.contamination(numbered, table(spark, sf_dir, "benchmark"), "_row")
    return _without(numbered, hits.select("doc_id"), "contaminated")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in the packed sequences."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, CONTEXT)
    return packing.pack(pieces, CONTEXT)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, on the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
