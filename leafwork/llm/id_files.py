"""Token-id shards with a minimal perfect hash index.

Documents are tokenized where they lie, dealt out by ranges of ``doc_id`` (which are found
from the ids alone, so nothing is tokenized twice or kept in between), and written in
ascending order as shards: raw little-endian ids, the keys in order, and an index.
The index is a minimal perfect hash (hash and displace): a key's bucket has a seed
that sends the key to a slot of its own; the slot holds a fingerprint, the offset and
the length. A lookup costs two hashes and one comparison, whatever the shard's size.
A shard holds about ``shard_ids`` ids, one document more at most, and is a row group of its
own with its first and last key, so that a lookup reads the payload of no other shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwork.llm.common import known_id, restored
from leafwork.llm.token_ids import TextEncoder

SHARD = (
    "part int, shard int, width int, start long, n_docs int, n_ids long, first_key long, last_key long, payload binary, keys binary,"
    " seeds binary, fingerprints binary, slots binary, offsets binary, lengths binary"
)
_BUCKET = 4  # mean number of keys that share a seed
_SPANS = 64  # ranges of keys that choose shards
_PART_DOCS = 100_000  # documents of a part, about


def mixed(keys: np.ndarray, seeds) -> np.ndarray:
    """64-bit hashes of keys, one function per seed."""
    x = keys.astype(np.uint64) ^ (np.atleast_1d(np.asarray(seeds, np.uint64)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BUCKET_SEED, _PRINT_SEED = (1 << 40) + 1, (1 << 40) + 2


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds per bucket and the slot of each key; keys must be distinct."""
    n = len(keys)
    buckets = max(1, -(-n // _BUCKET))
    bucket = (mixed(keys, _BUCKET_SEED) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    starts = np.cumsum(sizes) - sizes
    seeds, slots, taken = np.zeros(buckets, np.uint32), np.empty(n, np.int64), np.zeros(n, bool)
    tries = np.arange(64, dtype=np.uint64)[:, None]
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        members = order[starts[b] : starts[b] + sizes[b]]
        seed = 0
        while True:
            at = (mixed(keys[members][None, :], tries + np.uint64(seed)) % np.uint64(n)).astype(np.int64)
            good = ~taken[at].any(axis=1)
            if len(members) > 1:
                ranked = np.sort(at, axis=1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if good.any():
                k = int(good.argmax())
                seeds[b], slots[members] = seed + k, at[k]
                taken[at[k]] = True
                break
            seed += 64
    return seeds, slots


def lookup(keys: np.ndarray, seeds: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where the stored fingerprint is another key's."""
    n = len(fingerprints)
    if not n:
        return np.full(len(keys), -1, np.int64)
    bucket = (mixed(keys, _BUCKET_SEED) % np.uint64(len(seeds))).astype(np.int64)
    slot = (mixed(keys, seeds[bucket]) % np.uint64(n)).astype(np.int64)
    return np.where(fingerprints[slot] == fingerprint(keys), slot, -1)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, _PRINT_SEED) >> np.uint64(32)).astype(np.uint32)


def id_width(tokenizer: str, end_id: int) -> int:
    """Bytes that hold every id: two for small vocabularies, else four."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def id_ranges(docs: DataFrame, parts: int, id_col: str = "doc_id") -> np.ndarray:
    """The upper ends of ``parts`` ranges of ids with about as many rows each, but for the
    last range. An id that fills several ranges is the end of each of them."""
    if parts < 2:
        return np.empty(0, np.int64)
    at = [k / parts for k in range(1, parts)]
    ends = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), at, max(10_000, 10 * parts)).alias("e")).first()["e"]
    return np.array(ends or [], np.int64)


def tokenized(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    ends: np.ndarray | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
) -> DataFrame:
    """``part, doc_id, ids`` (little-endian, ``width`` bytes each, ``end_id`` last).

    ``part`` is the id's range, see :func:`id_ranges`; rows that repeat the end of several
    ranges are spread over them. Null texts count as empty, null ids come first.
    """
    rows = docs.select(known_id(F.col(id_col)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ends = np.empty(0, np.int64) if ends is None else ends

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = TextEncoder(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                ids = [np.append(encoder.encode(t), np.uint32(end_id)).astype(f"<u{width}").tobytes() for t in part["text"]]
                keys = part["doc_id"].to_numpy(np.int64)
                first, last = np.searchsorted(ends, keys, "left"), np.searchsorted(ends, keys, "right")
                spread = np.array([zlib.crc32(i) for i in ids], np.int64) % np.maximum(1, last - first)
                yield pd.DataFrame({"part": (first + spread).astype(np.int32), "doc_id": part["doc_id"].array, "ids": ids})

    return rows.mapInPandas(encode, "part int, doc_id long, ids binary")


def _shard_row(part: int, shard: int, width: int, start: int, keys: list, ids: list) -> dict:
    """One shard; a key that repeats is indexed at its first row and read in a run."""
    lengths = np.array([len(x) // width for x in ids], "<i8")
    offsets = (np.cumsum(lengths) - lengths).astype("<i8")
    names = np.array(keys, "<i8")
    first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
    seeds, slots = build_index(names[first])
    prints, at, count = np.empty(len(first), "<u4"), np.empty(len(first), "<i8"), np.empty(len(first), "<i8")
    prints[slots], at[slots] = fingerprint(names[first]), first
    count[slots] = np.diff(np.r_[first, len(names)])
    where = np.empty((len(first), 2), "<i8")
    where[:, 0], where[:, 1] = at, count
    return {
        "part": part, "shard": shard, "width": width, "start": start, "n_docs": len(keys), "n_ids": int(lengths.sum()),
        "first_key": keys[0], "last_key": keys[-1], "payload": b"".join(ids), "keys": names.tobytes(), "seeds": seeds.astype("<u4").tobytes(),
        "fingerprints": prints.tobytes(), "slots": where.tobytes(), "offsets": offsets.tobytes(), "lengths": lengths.tobytes(),
    }


def write_shards(ids: DataFrame, path: str, parts: int, shard_ids: int = 1_000_000, width: int = 4) -> None:
    """Write ``part, doc_id, ids`` as shards in ascending order of the id, nulls first.

    The parts are written in parallel, each as shards in order. Rows that repeat an id are
    kept, each for itself, in the order of their ids' bytes within a part.
    """
    dealt = ids.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys: list = []
        texts: list = []
        held = shard = start = 0
        now = -1
        for batch in batches:
            for part, key, one in zip(batch["part"], batch["doc_id"].array, batch["ids"].array, strict=True):
                if keys and (part != now or held >= shard_ids):
                    yield pd.DataFrame([_shard_row(now, shard, width, start, keys, texts)])
                    shard, start, held, keys, texts = shard + 1, start + held, 0, [], []
                if part != now:
                    now, shard, start = int(part), 0, 0
                keys.append(int(key))
                texts.append(one)
                held += len(one) // width
        if keys:
            yield pd.DataFrame([_shard_row(now, shard, width, start, keys, texts)])

    dealt.mapInPandas(build, SHARD).write.option("parquet.block.row.count.limit", "1").parquet(path)


def _ids(row, offset: int, length: int) -> bytes:
    """The ids of one document, as 32-bit little-endian numbers."""
    return np.frombuffer(row.payload, f"<u{row.width}", length, row.width * offset).astype("<u4").tobytes()


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, through the shards' indexes.

    ``start`` counts the ids of all documents before; it is the sum of the parts before
    (one number each), of the part's shards before, and of the shard's offset.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before.alias("base"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                names = np.unique(np.frombuffer(row.keys, "<i8"))
                slots = lookup(names, np.frombuffer(row.seeds, "<u4"), np.frombuffer(row.fingerprints, "<u4"))
                if (slots < 0).any():
                    raise ValueError("a stored key is not found in its shard's index")
                where = np.frombuffer(row.slots, "<i8").reshape(-1, 2)[slots]
                offsets, lengths = np.frombuffer(row.offsets, "<i8"), np.frombuffer(row.lengths, "<i8")
                at = np.concatenate([np.arange(a, a + n) for a, n in where])
                keys = np.repeat(names, where[:, 1])
                yield pd.DataFrame({
                    "doc_id": keys,
                    "start": offsets[at] + row.start + row.base,
                    "n_tokens": lengths[at],
                    "ids": [_ids(row, offsets[k], lengths[k]) for k in at],
                })

    # One row per part, and there are as many parts as write_shards() was asked for.
    return restored(shards.join(F.broadcast(bases), "part").mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary"))


def get_documents(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """The ids of a stated list of documents: two hashes and one comparison a key.

    Shards are chosen by their first and last keys, in up to ``_SPANS`` spans that leave out
    the widest gaps between the keys.
    """
    wanted = np.array(sorted(set(keys)), np.int64)
    gaps = np.sort(np.argsort(-np.diff(wanted.astype(object)), kind="stable")[: _SPANS - 1]) if len(wanted) > 1 else np.empty(0, np.int64)
    spans = np.split(wanted, gaps + 1) if len(wanted) else []
    near_keys = F.lit(False)
    for span in spans:
        near_keys |= (F.col("first_key") <= int(span[-1])) & (F.col("last_key") >= int(span[0]))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                stored_keys = np.frombuffer(row.keys, "<i8")
                near = wanted[(wanted >= stored_keys[0]) & (wanted <= stored_keys[-1])]
                slots = lookup(near, np.frombuffer(row.seeds, "<u4"), np.frombuffer(row.fingerprints, "<u4"))
                where = np.frombuffer(row.slots, "<i8").reshape(-1, 2)
                offsets, lengths = np.frombuffer(row.offsets, "<i8"), np.frombuffer(row.lengths, "<i8")
                out = [
                    (int(key), _ids(row, offsets[k], lengths[k]))
                    for key, slot in zip(near, slots, strict=True)
                    if slot >= 0
                    for k in range(where[slot, 0], where[slot, 0] + where[slot, 1])
                    if stored_keys[k] == key
                ]
                yield pd.DataFrame(out, columns=["doc_id", "ids"])

    return spark.read.schema(SHARD).parquet(path).where(near_keys).mapInPandas(find, "doc_id long, ids binary")


def write_token_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Tokenize whole texts and write the shards; an empty table gives no shard."""
    width = id_width(tokenizer, end_id)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // _PART_DOCS))
    ids = tokenized(docs, tokenizer, end_id, id_ranges(docs, parts, id_col), id_col, text_col, width)
    write_shards(ids, path, parts, width=width)
