"""Near-duplicate detection by b-bit MinHash, verified on full shingle sets.

One scan gives each text a digest of its words, the size of its shingle set, band keys
from rows of minima, and a signature of the low bits of all minima. Texts with equal
words are one class; its smallest id stands for it. Texts that share a band key are
candidates. They are compared in two steps, both estimated by counting equal low bits
(corrected for chance), then verified on the full sets:

1. every text with the text of its bucket that is best connected (the hub), and
   components are formed from the confirmed links;
2. the texts of buckets whose other members still lie in several components, by an exact
   join on their shingles. A shingle that no two components share can be ignored, and so
   can a text most of whose rest is too small; the others are put in order, rarest first,
   and two texts meet only at a shingle where what follows can still reach the threshold.

Within a family of copies the first step leaves few components, and the own words of a
distant copy rule it out in the second one, so neither makes the pairs of a bucket, and no
link that could join two components is left out. Components are found by exchanging
smallest labels between tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.common import known_id, restored, shingle_hashes, stored, word_hashes

ROWS, BANDS, BITS = 6, 40, 4  # a pair of similarity 0.85 shares no band once in 10**8
_HASHES = ROWS * BANDS
_SALTS = 16
_COINS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 32, (2, _HASHES), np.uint64)
_FACTORS = (_COINS[0] | np.uint64(1)).astype(np.uint32)
_SHIFTS = _COINS[1].astype(np.uint32)
SIGNED = "doc_id long, words binary, n_shingles long, bands array<long>, signature binary"


def text_words(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles; one of all words if they are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(shingle_hashes(word_hashes(words), min(size, len(words))))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set of shingles."""
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(_HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(folded), 2048):
        np.minimum(out, (folded[None, at : at + 2048] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, from all its minima and its number."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def packed_bits(least: np.ndarray) -> bytes:
    """The low ``BITS`` of every (mixed) minimum, two to a byte."""
    low = ((least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
    return (low[0::2] | (low[1::2] << np.uint32(4))).astype(np.uint8).tobytes()


_EQUAL = np.array([(v & 15 == 0) + (v >> 4 == 0) for v in range(256)], np.uint8)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity from signatures: share of equal bits, corrected for chance."""
    same = _EQUAL[one ^ many].sum(axis=-1, dtype=np.int64) / _HASHES
    chance = 1 / (1 << BITS)
    return (same - chance) / (1 - chance)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    rows = docs.select(known_id(F.col(id_col)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                out = []
                part = batch.iloc[at : at + 1000]
                for doc_id, text in zip(part["doc_id"].array, part["text"], strict=True):
                    words = text_words(text)
                    digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                    if not words:
                        out.append((doc_id, digest, 0, [], b""))
                        continue
                    shingles = shingle_set(words, shingle)
                    least = minima(shingles)
                    out.append((doc_id, digest, len(shingles), band_keys(least), packed_bits(least)))
                yield pd.DataFrame(out, columns=["doc_id", "words", "n_shingles", "bands", "signature"])

    return restored(rows.mapInPandas(sign, SIGNED))


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(_SALTS)).cast("int")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough; ``texts`` has ``doc_id, text``."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good, seen = [], {}
            for a, b, text_a, text_b in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                sets = []
                for key, text in ((a, text_a), (b, text_b)):
                    if key not in seen:
                        if len(seen) > 500:
                            seen.clear()
                        seen[key] = shingle_set(text_words(text), shingle)
                    sets.append(seen[key])
                shared = len(np.intersect1d(*sets, assume_unique=True))
                good.append(100 * shared >= percent * (len(sets[0]) + len(sets[1]) - shared))
            yield batch.loc[good, ["a", "b"]]

    return both.select("a", "b", "text_a", "text_b").mapInPandas(check, "a long, b long")


def components(links: DataFrame, name: str = "component") -> DataFrame:
    """``node, component``: the smallest node reachable, for every node of ``links`` (a, b).

    Each round takes the smallest label among a node and its neighbours, then the label
    of that label, so rounds follow the logarithm of the longest chain. All of it is
    joins between tables; nothing comes to the driver but whether a label changed.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias(name)), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col(name).alias("_near")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("_near").alias("_near"))
        )
        nearer = labels.join(near, "node").select("node", F.col(name).alias("_old"), F.least(name, "_near").alias("_at"))
        jump = labels.select(F.col("node").alias("_at"), F.col(name).alias("_jump"))
        new = stored(
            nearer.join(jump, "_at").select("node", F.least("_at", "_jump").alias(name), (F.least("_at", "_jump") != F.col("_old")).alias("_moved")),
            "labels",
        )
        labels = new.drop("_moved")
        if new.where("_moved").isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 85,
    shingle: int = 5,
    margin: float = 0.12,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row.

    Rows are linked if 100 times the shared shingles reach ``percent`` times the union.
    ``margin`` is how far an estimate may lie below the true similarity (five standard
    deviations at the threshold). Null texts and texts without words have no shingle and
    are linked with nothing. Equal texts are linked and have one representative; rows
    that repeat an id are one node. Rows without an id are nodes of their own with a null
    component, and stay. An empty table gives an empty one.
    """
    signed = stored(signatures(docs, id_col, text_col, shingle), "signatures")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("words").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Only texts with copies take part in the join; each class is dealt out in salted copies.
    # (Spark would judge the copies by the size before the explode: it must not broadcast them.)
    salted = classes.select("words", "rep", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt")).hint("merge")
    owned = stored(
        signed.withColumn("_salt", _salt("doc_id"))
        .join(salted, ["words", "_salt"], "left")
        .withColumn("rep", F.expr("if(doc_id is null, null, coalesce(rep, doc_id))"))
        .withColumn("bands", F.expr("if(rep = doc_id, bands, null)"))
        .withColumn("signature", F.expr("if(rep = doc_id, signature, null)"))
        .select("doc_id", "rep", "n_shingles", "bands", "signature"),
        "owned",
    )
    heads = owned.where("bands is not null and n_shingles > 0").select("doc_id", "bands", "signature")
    keys = heads.select("doc_id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = _with_hubs(stored(keys.join(shared, "key"), "members"))
    suspects = members.select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = stored(texts.join(suspects, F.col("doc_id") == F.col("_id"), "left_semi"), "suspects")

    least = percent / 100 - margin
    star = likely(_star(members), heads, least)
    first = components(confirmed(star, texts, percent, shingle))
    open_ = shingles_of(texts, _open(members, first), shingle)
    found = stored(confirmed(likely(_reachable(open_, percent), heads, least), texts, percent, shingle), "rest")
    of = lambda side: first.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    joined = found.join(of("a"), "a", "left").join(of("b"), "b", "left")
    second = components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    again = second.select(F.col("node").alias("component"), F.col("component").alias("_last"))
    grown = first.join(again, "component", "left").select("node", F.coalesce("_last", "component").alias("component"))
    alone = second.join(first.select("node"), "node", "left_anti").select("node", "component")
    labels = grown.unionByName(alone).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))).hint("merge")
    out = owned.select("doc_id", "n_shingles", F.col("rep").alias("node"), _salt("doc_id").alias("_salt"))
    component = F.coalesce("component", "node")
    return out.join(labels, ["node", "_salt"], "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def _with_hubs(members: DataFrame) -> DataFrame:
    """``key, doc_id, hub``: the hub of a bucket shares most buckets with others."""
    known = members.groupBy("doc_id").agg(F.sum("n").alias("_known"))
    hubs = members.join(known, "doc_id").groupBy("key").agg(F.max(F.struct("_known", (-F.col("doc_id")).alias("_id"))).alias("_hub"))
    return stored(members.join(hubs.select("key", (-F.col("_hub._id")).alias("hub")), "key").select("key", "doc_id", "hub"), "hubs")


def _star(members: DataFrame) -> DataFrame:
    """Each text of a bucket with its hub."""
    return members.where("hub != doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()


def likely(pairs: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """The pairs whose estimated similarity is not below ``least``."""
    side = lambda name: heads.select(F.col("doc_id").alias(name), F.col("signature").alias(f"s{name}"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                one, other = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), -1) for c in ("sa", "sb"))
                yield batch.loc[estimates(one, other) >= least, ["a", "b"]]

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb").mapInPandas(check, "a long, b long")


def _open(members: DataFrame, first: DataFrame) -> DataFrame:
    """``doc_id, component`` of texts in buckets that hold, beside the hub, several components."""
    at = first.select(F.col("node").alias("doc_id"), "component")
    placed = members.where("hub != doc_id").join(at, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("_least"), F.max("component").alias("_most")).where("_least != _most")
    return stored(placed.join(mixed, "key", "left_semi").select("doc_id", "component").distinct(), "open")


def shingles_of(texts: DataFrame, open_: DataFrame, size: int) -> DataFrame:
    """``doc_id, component, n, shingle``: one row for each shingle of each open text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["doc_id", "component", "text"]).to_pylist():
                shingles = shingle_set(text_words(row["text"]), size).view(np.int64)
                n = len(shingles)
                for at in range(0, n, 50_000):
                    part = shingles[at : at + 50_000]
                    fill = lambda v: np.full(len(part), v, np.int64)  # noqa: B023, E731
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": fill(row["doc_id"]), "component": fill(row["component"]), "n": fill(n), "shingle": part}
                    )

    rows = texts.join(open_, "doc_id").select("doc_id", "component", "text")
    return stored(rows.mapInArrow(read, "doc_id long, component long, n long, shingle long"), "open-shingles")


def _reachable(shingles: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of different components that may share enough shingles.

    Two texts of n and m shingles need ``percent * (n + m) / (100 + percent)`` common ones.
    All texts put their shingles in one order: first those within one component, which no
    link can share, then the rarest. If two texts first meet at places i and j, they share
    min(n - i, m - j) at most.
    """
    across = (
        shingles.groupBy("shingle")
        .agg(F.count(F.lit(1)).alias("_in"), F.min("component").alias("_least"), F.max("component").alias("_most"), F.min("n").alias("_short"))
        .where("_least != _most")
        .select("shingle", "_in", "_short")
    )
    whole = Window.partitionBy("doc_id")
    place = F.col("n") - F.count(F.lit(1)).over(whole) + F.row_number().over(whole.orderBy("_in", "shingle")) - 1
    left = shingles.join(across, "shingle").withColumn("_left", F.col("n") - place)
    # What a text needs to share with the shortest partner it can have at this shingle.
    needed = percent * (F.col("n") + F.greatest("_short", F.ceil(F.col("n") * percent / 100)))
    posted = stored(left.where(F.col("_left") * (100 + percent) >= needed).select("shingle", "doc_id", "component", "n", "_left"), "posted")
    one = posted.select("shingle", *(F.col(c).alias(f"{c}1") for c in ("doc_id", "component", "n", "_left")))
    other = posted.select("shingle", *(F.col(c).alias(f"{c}2") for c in ("doc_id", "component", "n", "_left")))
    meet = (
        (F.col("component1") < F.col("component2"))
        & (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
        & (F.least("_left1", "_left2") * (100 + percent) >= percent * (F.col("n1") + F.col("n2")))
    )
    pairs = one.join(other, "shingle").where(meet)
    return stored(pairs.select(F.col("doc_id1").alias("a"), F.col("doc_id2").alias("b")).distinct(), "reachable")
