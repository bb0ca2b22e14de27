"""The registered queries: each operator with production parameters on its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import (
    centroids,
    chat_format,
    collocations,
    decontaminate,
    exact_dedup,
    host_paths,
    id_files,
    language_mix,
    minhash,
    packing,
    pii,
    quality,
    secrets,
)
from leafwork.llm.common import crc_of_id, table
from leafwork.session import scratch_folder

CONTEXT = 2048


def _sha(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, secrets.train(secrets.labelled_tokens(docs)))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{secrets.KINDS[k]}") for k in range(3)),
        _sha(secrets.span_text(F.col("base"))).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.by_document(docs, hits)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(control).alias("text"),
    )
    messages = given.unionByName(extra).withColumn("parts", chat_format.text_part(F.col("text")))
    chats = chat_format.format_chats(messages)
    turns = chat_format.read_chats(F.col("formatted"))
    loss = chat_format.masked_text(F.col("formatted"), F.col("loss_spans"))
    read = chats.select("conv_id", "formatted", "attachments", "expanded_tokens", turns.alias("turns"), loss.alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _sha(F.array_join(lines, "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        _sha(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_of_id(F.col("doc_id")) % 4 == 2
    model = language_mix.train(docs.where(~held_out))
    return language_mix.identify(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages")
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_of_id(F.col("doc_id")) % 5 == 0
    stats = quality.stored_statistics(docs)
    model = quality.train(stats, labels.where(~held_out))
    return quality.score(stats, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, CONTEXT)
    packed = packing.pack(pieces, CONTEXT)
    return packed.withColumn("lower_bound", F.lit(packing.lower_bound(packed, CONTEXT)).cast("long"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_folder(spark)}/shards-{uuid.uuid4().hex}"
    id_files.write_token_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return id_files.read_shards(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{pii.KINDS[k]}") for k in range(4)),
        _sha(pii.span_text(base)).alias("base_sha256"),
        pii.span_text(F.col("spans")).alias("spans"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_paths.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, means = centroids.cluster(centroids.whole_vectors(table(spark, sf_dir, "embeddings")))
    return centroids.with_inertia(assigned, means)
