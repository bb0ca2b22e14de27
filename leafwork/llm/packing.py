"""Best-fit packing with certified partitions.

Documents become token pieces of at most ``capacity`` tokens in the scan; only ids and
lengths are shuffled. Each partition packs its pieces by best-fit decreasing and
bounds the number of bins from below by dual-feasible functions. A partition whose
bins equal the bound is certified and stays. The others open their emptiest bins, whose
pieces are dealt into fewer, mixed partitions and packed again; the new bins are taken
if they are fewer. Rounds end when one partition is left, nothing is open, or a round
saved no bin. Each sequence tells whether its partition was certified, and the bound over
all pieces tells how far the whole is from certain.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import known_id, restored, stored
from leafwork.llm.token_ids import TextEncoder


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document's pieces, and a row number.

    A document is its text's ids and ``end_id``; null counts as empty, so every row has
    one piece at least. Only documents longer than ``capacity`` are cut, and then the
    first piece is the one that may be shorter.
    """
    rows = docs.select(known_id(F.col(id_col)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = TextEncoder(tokenizer)
        end, row = np.array([end_id], "<u4"), 0
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"].array, strict=True):
                ids = np.concatenate([encoder.encode(text).astype("<u4", copy=False), end])
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
                    out.append((doc_id, k, a, z - a, zlib.crc32(ids[a:z].tobytes()), row))
                    row += 1
            yield pd.DataFrame(out, columns=_FIELDS)

    return restored(rows.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, _row long"))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece: longest first, each into the fullest bin that has room."""
    bins = np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made = 0, 0  # bit r is set if a bin has room for exactly r tokens
    for at in np.argsort(-lengths, kind="stable"):
        need = int(lengths[at])
        fitting = mask >> need
        if fitting:
            left = need + (fitting & -fitting).bit_length() - 1
            chosen = room[left].pop()
            if not room[left]:
                mask &= ~(1 << left)
        else:
            left, chosen, made = capacity, made, made + 1
        bins[at] = chosen
        if left > need:
            room[left - need].append(chosen)
            mask |= 1 << (left - need)
    return bins


def bins_needed(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound on the number of bins, the best of two dual-feasible families.

    For a threshold t up to half the capacity, pieces longer than ``capacity - t`` count
    as a whole bin, shorter than t as nothing, others by length; for k, the rounded
    function of (k + 1) x / capacity counts in parts of 1 / k.
    """
    return _bound(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def _bound(counts: np.ndarray, capacity: int) -> int:
    """The same, from how often each length occurs."""
    sizes = np.arange(capacity + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * sizes)
    t = np.arange(capacity // 2 + 1)
    below = np.where(t > 0, total[t - 1], 0)
    middle = total[capacity - t] - below
    whole = number[capacity] - number[capacity - t]
    best = int((whole + -(-middle // capacity)).max())
    for k in range(1, 33):
        scaled = (k + 1) * sizes
        parts = np.where(scaled % capacity == 0, sizes * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((parts * counts).sum()) // (k * capacity)))
    return best


_FIELDS = ["doc_id", "piece", "start", "length", "ids_crc32", "_row"]
_PACKED = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, _row long,"
    " sequence_id long, offset long, certified boolean, _open boolean"
)


def _packer(capacity: int, level: int):
    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _pack_group(key, rows, capacity, level)

    return packed


def _pack_group(key: tuple, rows: pd.DataFrame, capacity: int, level: int) -> pd.DataFrame:
    rows = rows.sort_values(["length", "ids_crc32", "doc_id", "piece", "_row"], ascending=[False, True, True, True, True], kind="stable")
    lengths = rows["length"].to_numpy(np.int64)
    bins = best_fit_decreasing(lengths, capacity)
    ids = bins + (level << 52) + (int(key[0]) << 24)
    if level:
        came = rows["sequence_id"].to_numpy(np.int64)
        if len(np.unique(came)) <= bins.max() + 1:  # no gain: the bins stay as they came
            ids = came
    order = np.argsort(ids, kind="stable")
    rows, ids, lengths = rows.iloc[order], ids[order], lengths[order]
    names, first, fill_at = np.unique(ids, return_index=True, return_inverse=True)
    fill = np.add.reduceat(lengths, first)
    before = np.cumsum(lengths) - lengths
    # The emptiest bins are opened, until their room could take what is above the bound.
    surplus = len(names) - bins_needed(lengths, capacity)
    opened = np.zeros(len(names), bool)
    if surplus > 0:
        emptiest = np.argsort(fill, kind="stable")
        room = np.cumsum((capacity - fill)[emptiest])
        opened[emptiest[: max(2, int(np.searchsorted(room, 2 * surplus * capacity)) + 1)]] = True
        opened &= fill < capacity
    return rows.assign(
        sequence_id=ids, offset=before - before[first][fill_at], certified=surplus <= 0, _open=opened[fill_at]
    )[[*_FIELDS, "sequence_id", "offset", "certified", "_open"]]


def pack(pieces: DataFrame, capacity: int = 2048, group_rows: int = 100_000, max_rounds: int | None = None) -> DataFrame:
    """Adds ``sequence_id``, ``offset`` and ``certified`` to ``doc_id, piece, start, length, ids_crc32``.

    Pieces are dealt into groups of about ``group_rows`` by a hash, so the work of a task
    is bounded; what uncertified groups open is dealt anew, again in groups of that
    size, until one group is left, nothing is open, a round saves no sequence or, where
    it is given, ``max_rounds`` have run. Every
    piece is placed once, sequences hold at most ``capacity`` tokens, offsets are gapless
    from 0. ``certified`` says that the group that made a sequence needed all of its
    sequences; see :func:`lower_bound` for the whole. Lengths must be from 1 to ``capacity``.
    Repeated rows are packed each for itself; null ids are packed like others; an empty
    table gives an empty one.
    """
    numbered = pieces if "_row" in pieces.columns else pieces.withColumn("_row", F.monotonically_increasing_id())
    dealt = stored(numbered.select(*_FIELDS).withColumn("doc_id", known_id(F.col("doc_id"))), "pieces")
    left, level, done, held = dealt.count(), 0, [], None
    while True:
        groups = max(1, -(-left // group_rows))
        key = F.pmod(F.xxhash64("ids_crc32", "_row", F.lit(level)), F.lit(groups)).cast("long")
        packed = stored(
            dealt.withColumn("_group", key).groupBy("_group").applyInPandas(_packer(capacity, level), _PACKED),
            f"packed-{level}",
        )
        level += 1
        # Sequences begin at offset 0, so they are counted without a shuffle.
        begun = packed.where("offset = 0").agg(F.count(F.lit(1)).alias("all"), F.count_if("_open").alias("open")).first()
        if groups == 1 or not begun["open"] or level == max_rounds or (held is not None and begun["all"] >= held):
            done.append(packed)
            break
        done.append(packed.where("not _open"))
        dealt, held = packed.where("_open"), begun["open"]
        left = dealt.count()
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return restored(out.drop("_row", "_open"))


def lower_bound(pieces: DataFrame, capacity: int = 2048) -> int:
    """The number of sequences that no packing of all ``pieces`` can do without.

    Only how often each length occurs comes to the driver: ``capacity`` numbers.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["length"]] = row["n"]
    return _bound(counts, capacity)
