"""Benchmark decontamination by SimHash windows of the items' own sizes.

Benchmark items are a stated query set, taken in blocks of bounded size. A text is
looked at through windows as long as an item: all those that hold as many shingles of
the item as the threshold asks for, by a sliding count, so that no window that can match
is passed over. Each window's SimHash is looked up in a multi-index: eight blocks of
eight bits, each listing the items within ``radius // 8`` bits, so by the pigeonhole
principle every item within ``radius`` is found. Candidates are verified exactly: the
weighted Jaccard similarity of the two shingle multisets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import known_id, restored, shingle_hashes, stored, word_hashes

_WORD = re.compile(r"[^\W_]+")
_FILTER_BITS = 20
_RUN = 4096  # windows fingerprinted at a time
RESULT = "doc_id long, item_id long, similarity double, start long, length long"


def words_of(text: str) -> np.ndarray:
    """Hashes of a text's words: letters and digits, in lower case."""
    return word_hashes(_WORD.findall(text.lower()))


def simhashes(shingles: np.ndarray, size: int) -> np.ndarray:
    """64-bit SimHash of every run of ``size`` shingles; a shingle weighs as often as it occurs."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.concatenate([np.zeros((1, 64), np.int32), bits.cumsum(axis=0, dtype=np.int32)])
    votes = 2 * (sums[size:] - sums[:-size]) > size
    return np.packbits(votes, axis=1, bitorder="little").view("<u8")[:, 0]


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller counts over the sum of the larger ones."""
    names, at = np.unique(np.r_[a, b], return_inverse=True)
    mine = np.bincount(at[: len(a)], minlength=len(names))
    theirs = np.bincount(at[len(a) :], minlength=len(names))
    most = np.maximum(mine, theirs).sum()
    return float(np.minimum(mine, theirs).sum() / most) if most else 0.0


class ItemIndex:
    """One block of items: their shingles by value, and the multi-index of fingerprints."""

    def __init__(self, items: list[tuple[int, str]], size: int = 5, radius: int = 31) -> None:
        self.radius = radius
        self.ids, self.words, self.sizes, self.shingles, prints = [], [], [], [], []
        for item_id, text in items:
            words = words_of(text or "")
            if not len(words):
                continue
            k = min(size, len(words))
            self.ids.append(item_id)
            self.words.append(len(words))
            self.sizes.append(k)
            self.shingles.append(shingle_hashes(words, k))
            prints.append(simhashes(self.shingles[-1], len(self.shingles[-1]))[0])
        self.prints = np.array(prints, np.uint64)
        blocks = self.prints.view(np.uint8).reshape(-1, 8) if prints else np.empty((0, 8), np.uint8)
        distance = np.array([bin(v).count("1") for v in range(256)], np.uint8)
        values = np.arange(256, dtype=np.uint8)
        # near[block, value, item]
        self.near = distance[values[None, :, None] ^ blocks.T[:, None, :]] <= radius // 8
        self.places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in set(self.sizes):
            own = [i for i, s in enumerate(self.sizes) if s == k]
            hashes = np.concatenate([self.shingles[i] for i in own])
            item = np.concatenate([np.full(len(self.shingles[i]), i) for i in own])
            order = np.argsort(hashes, kind="stable")
            known = np.zeros(1 << _FILTER_BITS, bool)
            known[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.places[k] = (hashes[order], item[order], known)

    def _windows(self, shingles: np.ndarray, k: int, least: float) -> Iterator[tuple[int, np.ndarray]]:
        """Each item with the starts of all windows that hold enough of its shingles.

        Two windows of n and m shingles whose similarity is ``least`` share
        ``least * (n + m) / (1 + least)`` of them, with multiplicity; each is a place in
        the text's window where some shingle of the item stands.
        """
        hashes, item, known = self.places[k]
        at = np.flatnonzero(known[(shingles >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        low = np.searchsorted(hashes, shingles[at], "left")
        many = np.searchsorted(hashes, shingles[at], "right") - low
        if not many.any():
            return
        rows = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
        met = np.unique(item[rows] * np.int64(len(shingles)) + np.repeat(at, many))
        owner, place = met // len(shingles), met % len(shingles)
        edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        for a, z in zip(edges, np.r_[edges[1:], len(owner)], strict=True):
            size = len(self.shingles[owner[a]])
            window = min(size, len(shingles))
            needed = max(1, int(np.ceil(least * (window + size) / (1 + least) - 1e-9)))
            here = place[a:z]
            if len(here) < needed:
                continue
            first = np.maximum(here[needed - 1 :] - window + 1, 0)
            last = np.minimum(here[: len(here) - needed + 1], len(shingles) - window)
            starts = [np.arange(f, t + 1) for f, t in zip(first, last, strict=True) if f <= t]
            if starts:
                yield int(owner[a]), np.unique(np.concatenate(starts))

    def matches(self, words: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
        """(item id, similarity, first word, words) of the first best window of each item found."""
        best: dict[int, tuple[float, int, int]] = {}
        for k in self.places:
            shingles = shingle_hashes(words, k)
            if not len(shingles):
                continue
            for item, starts in self._windows(shingles, k, least):
                mine = self.shingles[item]
                size = min(len(mine), len(shingles))
                for start in self._near(shingles, item, starts, size):
                    found = weighted_similarity(shingles[start : start + size], mine)
                    if found >= least and found > best.get(item, (0.0, 0, 0))[0]:
                        best[item] = (found, int(start), min(self.words[item], len(words)))
                        if found == 1:
                            break
        return [(self.ids[i], *best[i]) for i in sorted(best)]

    def _near(self, shingles: np.ndarray, item: int, starts: np.ndarray, size: int) -> Iterator[int]:
        """The starts whose window's fingerprint is within the radius of the item's."""
        runs = np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1)
        for run in runs:
            for at in range(0, len(run), _RUN):
                part = run[at : at + _RUN]
                marks = simhashes(shingles[part[0] : part[-1] + size], size)
                blocks = marks.view(np.uint8).reshape(-1, 8)
                listed = self.near[np.arange(8)[None, :], blocks, item].any(axis=1)
                yield from part[listed & (np.bitwise_count(marks ^ self.prints[item]) <= self.radius)]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = 0.8,
    shingle: int = 5,
    radius: int = 31,
    block_items: int = 5000,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """``doc_id, item_id, similarity, start, length``: each item found in each row.

    ``start`` and ``length`` count words; of equally similar windows the first is given.
    Items without words, null items and texts, match nothing; items of fewer than
    ``shingle`` words are one shingle. Repeated rows give repeated results, repeated items
    count once; an empty table or benchmark gives none. Items are read in blocks of about
    ``block_items`` and ``block_bytes`` of text, one after the other, so what the driver
    and the tasks hold does not grow with the benchmark.
    """
    rows = docs.select(known_id(F.col(id_col)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items = benchmark.select(known_id(F.col("item_id")).alias("item_id"), F.col("text").alias("text")).distinct()
    sizes = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-sizes["n"] // block_items), -(-(sizes["bytes"] or 0) // block_bytes))
    # Blocks by a hash: every item is in one of them.
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        index = [(r["item_id"], r["text"]) for r in part.collect()]
        shared = docs.sparkSession.sparkContext.broadcast(sorted(index, key=lambda x: (x[0], x[1] or "")))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = ItemIndex(shared.value, shingle, radius)
            for batch in batches:
                found = [
                    (doc_id, *match)
                    for doc_id, text in zip(batch["doc_id"].array, batch["text"], strict=True)
                    for match in index.matches(words_of(text), least)
                ]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "similarity", "start", "length"])

        hits = rows.mapInPandas(search, RESULT)
        if blocks > 1:
            hits = stored(hits, f"hits-{block}")
            shared.unpersist()
        out = hits if out is None else out.unionByName(hits)
    return restored(restored(out), "item_id")


def by_document(docs: DataFrame, hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, contaminated, item_ids, similarity, spans`` for each row of ``docs``.

    The list is as long as the items found in one text, each with its best window.
    """
    found = hits.groupBy(F.col("doc_id").alias("_hit")).agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"),
        F.max("similarity").alias("similarity"),
        F.sort_array(F.collect_set(F.struct("start", "length", "item_id"))).alias("spans"),
    )
    return docs.select(F.col(id_col).alias("doc_id")).join(found, F.col("doc_id") == F.col("_hit"), "left").select(
        "doc_id",
        F.col("_hit").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.coalesce("spans", F.array().cast("array<struct<start:long,length:long,item_id:long>>")).alias("spans"),
    )
