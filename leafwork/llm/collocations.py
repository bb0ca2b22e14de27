"""Phrase collocation mining with weighted acyclic automata.

1. Every task counts the phrases of up to three words of bounded shards of its texts, and
   sends one automaton of each shard to each range of phrases that the shard meets.
2. Each range's automata are united; what is left after the least count is stored.
3. The parts of every candidate are looked up by composing lists of parts with the
   automaton of their range. A range that is asked for often is dealt out in copies.
4. Scores are exact decimals; each language's best are found in slices first.

Ranges are cut at phrases of a small sample, so that a frequent first word is cut by its
second one; the sample decides on balance alone, never on results. A phrase that occurs
often enough has parts that do, so nothing is lost by the least count before step 3.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.common import hashed_sample, stored
from leafwork.llm.count_automaton import BITS, MASK, Automaton, word_array

_DELIMITERS = b".,;:!?\n\x0b\x0c\r"
_CUT = b"\xff"  # never a byte of UTF-8
_TABLE = bytes.maketrans(
    bytes(range(65, 91)) + b"\t" + _DELIMITERS, bytes(range(97, 123)) + b" " + _CUT * len(_DELIMITERS)
)
_PIECE = 1 << 20  # bytes of a text split at a time
_HELD = 1_500_000  # arcs united at a time
SHARD = "range int, automaton binary, langs array<string>, words array<long>"
ASK = "range int, one binary, two binary, lang string, phrase string, a long, role int"
ANSWER = "lang string, phrase string, a long, role int, count long"


def words_of(text: str) -> Iterator[list[bytes]]:
    """A text's words in order, with ``_CUT`` between pieces, in bounded lists."""
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(data):
        end = at + _PIECE
        if end < len(data):
            ends = [e for e in (data.find(b" ", end), data.find(_CUT, end)) if e >= 0]
            end = min(ends, default=len(data))
        yield data[at:end].replace(_CUT, b" \xff ").split()
        at = end


class _Numbers(dict):
    """Numbers, from 1, of the words of one language within a shard; 0 for a cut."""

    def __init__(self, lang: str, names: list[bytes]) -> None:
        super().__init__({_CUT: 0})
        self.prefix, self.names = lang.encode("utf-8", "surrogatepass") + b"\n", names

    def __missing__(self, word: bytes) -> int:
        self.names.append(self.prefix + word)
        self[word] = len(self.names)
        return len(self.names)


class Shard:
    """Counts the phrases of texts until it is full, then gives them as sorted keys."""

    def __init__(self, most_words: int) -> None:
        self.most_words = most_words
        self.clear()

    def clear(self) -> None:
        self.names: list[bytes] = []
        self.langs: dict[str, _Numbers] = {}
        self.parts: list[np.ndarray] = []
        self.size = self.carried = 0

    def full(self) -> bool:
        return self.size >= self.most_words or len(self.names) >= MASK - _PIECE

    def add(self, lang: str, words: list[bytes]) -> None:
        numbers = self.langs.setdefault(lang, _Numbers(lang, self.names))
        self.parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def carry(self, lang: str) -> list[bytes]:
        """The last two words, which begin phrases that go on in the next shard."""
        last: list[int] = []
        for part in reversed(self.parts):
            last = part[-2:].tolist() + last
            if len(last) >= 2:
                break
        prefix = len(self.langs[lang].prefix)
        return [self.names[i - 1][prefix:] if i else _CUT for i in [0, 0, *last][-2:]]

    def counted(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Sorted keys, counts and sorted words. Words carried over only begin phrases."""
        names = word_array(self.names)
        order = pa.compute.sort_indices(names).to_numpy()
        rank = np.zeros(len(order) + 1, np.int64)
        rank[order + 1] = np.arange(1, len(order) + 1)
        ids = rank[np.concatenate([np.zeros(2, np.int64), *self.parts])]
        skip = 2 + self.carried
        third, second, first = ids[skip:], ids[skip - 1 : -1], ids[skip - 2 : -2]
        two, three = (third > 0) & (second > 0), (third > 0) & (second > 0) & (first > 0)
        keys = np.concatenate([
            third[third > 0] << (2 * BITS),
            (second[two] << (2 * BITS)) | (third[two] << BITS),
            (first[three] << (2 * BITS)) | (second[three] << BITS) | third[three],
        ])
        keys.sort()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        return keys[starts], np.diff(np.r_[starts, len(keys)]), names.take(pa.array(order))


def _cut_keys(bounds: list[tuple], words: pa.Array) -> np.ndarray:
    """For each bound, the smallest key of a shard that is not below it."""
    names, out = words.to_pylist(), []
    for bound in bounds:
        key = 0
        for depth, word in enumerate(bound):
            at = bisect.bisect_left(names, word)
            key |= (at + 1) << (BITS * (2 - depth))
            if at == len(names) or names[at] != word:
                break
        out.append(key)
    return np.array(out, np.int64)


def _lang(column: str):
    return F.coalesce(F.col(column), F.lit("und"))


def _range_of(bounds: list[tuple], phrase: tuple) -> int:
    return bisect.bisect_right(bounds, phrase)


def range_bounds(docs: DataFrame, lang_col: str, text_col: str, ranges: int) -> list[tuple]:
    """Phrases that cut the phrases of a sample into ``ranges`` ranges.

    The sample has about two documents a range, 1,000 at least, and of each at most 500
    phrases; bounds of a phrase with long words are cut at 64 bytes a word.
    """
    if ranges < 2:
        return []
    sample = hashed_sample(docs, F.struct(F.col(lang_col), F.xxhash64(text_col)), max(1000, 2 * ranges))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                prefix, met = lang.encode("utf-8", "surrogatepass") + b"\n", 0
                for words in words_of(text):
                    for i in range(0, len(words) - 2, 8):
                        if _CUT not in words[i : i + 3] and met < 500:
                            met += 1
                            out.add(tuple((prefix + w)[: 64 + len(prefix)] for w in words[i : i + 3]))
            yield pa.RecordBatch.from_pydict({"phrase": pa.array([list(p) for p in out], pa.list_(pa.binary()))})

    rows = sample.select(_lang(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    met = sorted({tuple(bytes(w) for w in r["phrase"]) for r in rows.mapInArrow(read, "phrase array<binary>").collect()})
    return sorted({met[len(met) * k // ranges] for k in range(1, ranges)}) if met else []


def shards(docs: DataFrame, bounds: list[tuple], lang_col: str, text_col: str, shard_words: int) -> DataFrame:
    """One automaton for each shard and range that meet, and the shard's words by language."""

    def cut(shard: Shard) -> pa.RecordBatch:
        keys, counts, words = shard.counted()
        edges = np.r_[0, np.searchsorted(keys, _cut_keys(bounds, words)), len(keys)]
        rows = [
            (r, Automaton.from_sorted(keys[a:z], counts[a:z], words).dump())
            for r, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True))
            if z > a
        ]
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["range", "automaton"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(shard_words)
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                lang = lang.as_py()
                for words in words_of(text.as_py()):
                    shard.add(lang, words)
                    if shard.full():
                        last = shard.carry(lang)
                        yield cut(shard)
                        shard.clear()
                        shard.add(lang, last)
                        shard.carried = 2
                shard.add(lang, [_CUT])
        if shard.size:
            yield cut(shard)

    rows = docs.select(_lang(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(build, "range int, automaton binary")


def united(parts: DataFrame, ranges: int, least: int) -> DataFrame:
    """``range, automaton, langs, words``: each range's phrases with ``least`` occurrences or more,
    and how many words of each language begin in it."""
    dealt = parts.repartitionById(ranges, F.col("range")).sortWithinPartitions("range")

    def finish(at: int, held: list[Automaton]) -> pa.RecordBatch:
        whole = Automaton.union(held)
        langs: dict[str, int] = {}
        single = np.flatnonzero(whole.weight[0])
        for name, n in zip(whole.words.take(pa.array(whole.label[0][single])).to_pylist(), whole.weight[0][single].tolist(), strict=True):
            lang = name[: name.rindex(b"\n")].decode("utf-8", "surrogatepass")
            langs[lang] = langs.get(lang, 0) + n
        return pa.RecordBatch.from_arrays(
            [
                pa.array([at], pa.int32()),
                pa.array([whole.at_least(least).dump()], pa.binary()),
                pa.array([list(langs)], pa.list_(pa.string())),
                pa.array([list(langs.values())], pa.list_(pa.int64())),
            ],
            ["range", "automaton", "langs", "words"],
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, arcs, most = -1, [], 0, _HELD
        for batch in batches:
            for number, blob in zip(batch.column("range").to_pylist(), batch.column("automaton"), strict=True):
                if number != at:
                    if held:
                        yield finish(at, held)
                    at, held, arcs, most = number, [], 0, _HELD
                held.append(Automaton.load(blob.as_py()))
                arcs += sum(map(len, held[-1].label))
                if arcs > most:
                    held = [Automaton.union(held)]
                    arcs = sum(map(len, held[0].label))
                    most = max(_HELD, 2 * arcs)
        if held:
            yield finish(at, held)

    return dealt.mapInArrow(merge, SHARD)


# What a part is to a candidate: the first or the rest, at the first or the second cut.
_PARTS = {2: ((0, 0, 1), (1, 1, 2)), 3: ((0, 0, 1), (1, 1, 3), (2, 0, 2), (3, 2, 3))}


def asked(counts: DataFrame, bounds: list[tuple]) -> DataFrame:
    """One row for each part of each candidate, with the range that knows its count."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("automaton"):
                automaton = Automaton.load(blob.as_py())
                names = automaton.words.to_pylist()
                rows, weights = automaton.phrases()
                long = rows[:, 1] >= 0
                rows, weights = rows[long].tolist(), weights[long].tolist()
                for at in range(0, len(rows), 20_000):
                    out: list[tuple] = []
                    for row, a in zip(rows[at : at + 20_000], weights[at : at + 20_000], strict=True):
                        words = tuple(names[i] for i in row if i >= 0)
                        cut = words[0].rindex(b"\n")
                        lang = words[0][:cut].decode("utf-8", "surrogatepass")
                        phrase = b" ".join(w[cut + 1 :] for w in words).decode("utf-8", "surrogatepass")
                        for role, i, j in _PARTS[len(words)]:
                            part = words[i:j]
                            out.append((_range_of(bounds, part), part[0], part[1] if j - i > 1 else None, lang, phrase, a, role))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int32()), strict=True)],
                        ["range", "one", "two", "lang", "phrase", "a", "role"],
                    )

    return counts.select("automaton").mapInArrow(ask, ASK)


def answered(asks: DataFrame, counts: DataFrame, chunk: int = 50_000) -> DataFrame:
    """``lang, phrase, a, role, count``: each part's count, from the automaton of its range.

    A range meets its questions in groups of about ``chunk``, each with a copy of the automaton.
    """
    asks = stored(asks, "asks")
    many = asks.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_groups"))
    dealt = asks.join(many, "range").withColumn("_group", F.pmod(F.xxhash64("lang", "phrase"), F.col("_groups")).cast("int"))
    copies = counts.join(many, "range").withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
    both = dealt.select("range", "_group", F.lit(None).cast("binary").alias("automaton"), "one", "two", "lang", "phrase", "a", "role").unionByName(
        copies.select("range", "_group", "automaton"), allowMissingColumns=True
    )
    met = both.repartition("range", "_group").sortWithinPartitions("range", "_group", F.col("automaton").isNull())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = None
        for batch in batches:
            blobs = batch.column("automaton")
            edges = np.flatnonzero(blobs.is_valid().to_numpy(zero_copy_only=False))
            for a, z in zip(np.r_[0, edges].tolist(), np.r_[edges, batch.num_rows].tolist(), strict=True):
                part = batch.slice(a, z - a)
                if part.num_rows and part.column("automaton")[0].is_valid:
                    automaton = Automaton.load(part.column("automaton")[0].as_py())
                    part = part.slice(1)
                if part.num_rows:
                    words = [part.column(c).cast(pa.large_binary()) for c in ("one", "two")]
                    count = pa.array(automaton.compose(words), pa.int64())
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("lang", "phrase", "a", "role")), count], ["lang", "phrase", "a", "role", "count"])

    return met.mapInArrow(answer, ANSWER)


def scored(answers: DataFrame, within_percent: int) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the candidates that no longer one stands for."""
    part = lambda role: F.max(F.when(F.col("role") == role, F.col("count")))
    rows = answers.groupBy("lang", "phrase").agg(F.max("a").alias("a"), *(part(k).alias(f"p{k}") for k in range(4)))
    exact = lambda c: F.col(c).cast("decimal(38,0)")

    def score(left: str, right: str):
        return F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * exact("a") * exact("a"), exact(left) * exact(right))

    rows = rows.select("lang", "phrase", "a", "p0", "p1", "p2", "p3", score("p0", "p1").alias("s0"), score("p2", "p3").alias("s1"))
    later = F.col("s1") < F.col("s0")  # null where there is one cut only
    rows = stored(
        rows.select(
            "lang", "phrase", "a", "p1", "p2", F.col("s1").isNotNull().alias("_long"),
            F.when(later, F.col("p2")).otherwise(F.col("p0")).alias("l"),
            F.when(later, F.col("p3")).otherwise(F.col("p1")).alias("r"),
            F.when(later, F.col("s1")).otherwise(F.col("s0")).cast("long").alias("score"),
        ),
        "scored",
    )
    # A phrase of three words stands for its halves of two that occur seldom without it.
    inner = F.array(
        F.struct(F.substring_index("phrase", " ", 2).alias("phrase"), F.col("p2").alias("n")),
        F.struct(F.substring_index("phrase", " ", -2).alias("phrase"), F.col("p1").alias("n")),
    )
    halves = rows.where("_long").select("lang", "a", F.explode(inner).alias("_half"))
    dropped = halves.where(F.col("a") * 100 >= F.col("_half.n") * within_percent).select(F.col("lang").alias("_lang"), F.col("_half.phrase").alias("_phrase"))
    kept = rows.join(dropped, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left_anti")
    return kept.select("lang", "phrase", "a", "l", "r", "score")


_SLICES = 16


def best(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each language by score, count and phrase, with their ``rank``."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    cut = rows.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(_SLICES)))
    first = cut.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).where(F.col("_n") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= k).drop("_slice", "_n")


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = 10,
    within_percent: int = 50,
    k: int = 2000,
    range_bytes: int = 16 << 20,
    shard_words: int = 1_000_000,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of two or three words.

    Null texts count as empty, a null language as ``und``; repeated rows count as often as
    they occur. Ties are broken by count, then phrase in byte order. An empty table gives
    an empty one. ``range_bytes`` of text make one range, whose distinct phrases one task
    unites; a shard holds ``shard_words`` words, a task one shard at a time.
    """
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    bounds = range_bounds(docs, lang_col, text_col, max(16, -(-size // range_bytes)))
    counts = stored(united(shards(docs, bounds, lang_col, text_col, shard_words), len(bounds) + 1, least), "phrase-counts")
    found = best(scored(answered(asked(counts, bounds), counts.select("range", "automaton")), within_percent), k)
    pairs = F.explode(F.arrays_zip("langs", "words"))
    totals = counts.select(pairs.alias("_pair")).groupBy(F.col("_pair.langs").alias("lang")).agg(F.sum("_pair.words").alias("n"))
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
