"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in one scan. Trees are grown level by level on
binned statistics of a bounded sample of labelled rows, by histograms of gradients.
The trees are complete and flattened into arrays, so scoring walks all trees for all
rows of a batch with a few numpy look-ups per level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import hashed_sample, known_id, restored, stored

_CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "common", "symbol", "other")
STATISTICS = (
    "log_chars", "log_words", *(f"share_{c}" for c in _CLASSES), "mean_word", "long_words", "distinct_words",
    "top_word", "repeated_lines", "mean_line", "stopped_lines", "upper_words", "symbol_words", "char_entropy",
    "repeated_pairs", "digit_words", "short_lines",
)
_TABLE: np.ndarray | None = None


def _char_classes() -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        table = np.full(0x110000, 8, np.uint8)
        for code in range(0x3000):
            char = chr(code)
            if char.isalpha():
                table[code] = 1 if char.isupper() else 0
            elif char.isdigit():
                table[code] = 2
            elif char == "\n":
                table[code] = 4
            elif char.isspace():
                table[code] = 3
            elif char in ".!?":
                table[code] = 5
            elif char in ",;:'\"()-":
                table[code] = 6
            elif code < 128:
                table[code] = 7
        _TABLE = table
    return _TABLE


_SYMBOL = re.compile(r"[#$%&*@^~|<>{}\[\]\\/=+_]")


def statistics(text: str) -> list[float]:
    """The numbers in ``STATISTICS`` of a whole text; zeros where it has nothing to count."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = max(1, len(codes))
    shares = np.bincount(_char_classes()[codes], minlength=len(_CLASSES)) / n
    words = text.split()
    m = max(1, len(words))
    counts: dict[str, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    lines = [line for line in text.split("\n") if line.strip()]
    k = max(1, len(lines))
    chars = np.bincount(codes[codes < 512], minlength=1)
    chars = chars[chars > 0] / max(1, chars.sum())
    pairs = set(zip(words, words[1:], strict=False))
    symbols = sum(c for w, c in counts.items() if _SYMBOL.search(w))
    return [
        np.log1p(len(text)), np.log1p(len(words)), *shares, sum(map(len, words)) / m,
        sum(c for w, c in counts.items() if len(w) > 12) / m, len(counts) / m,
        max(counts.values(), default=0) / m, 1 - len(set(lines)) / k if lines else 0.0, len(text) / k / 100,
        sum(line.rstrip()[-1] in ".!?" for line in lines) / k,
        sum(c for w, c in counts.items() if w.isupper()) / m, symbols / m, float(-(chars * np.log2(chars)).sum()) if len(chars) else 0.0,
        1 - len(pairs) / (m - 1) if m > 1 else 0.0, sum(c for w, c in counts.items() if w[0].isdigit()) / m,
        sum(len(line) < 30 for line in lines) / k,
    ]


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, statistics`` of each row; null counts as empty."""
    rows = docs.select(known_id(F.col(id_col)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "statistics": [statistics(t) for t in batch["text"]]})

    return restored(rows.mapInPandas(count, "doc_id long, statistics array<float>"))


@dataclass(frozen=True)
class Trees:
    """Complete trees: ``feature`` and ``cut`` by tree and inner node, ``leaf`` by tree and leaf."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def binned(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, rows[:, k], side="right") for k, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1; all trees step down one level at a time."""
        total = np.full(len(rows), self.start)
        if self.feature.size:
            bins, trees = self.binned(rows), np.arange(len(self.feature))[None, :]
            node = np.zeros((len(rows), len(self.feature)), np.int64)
            line = np.arange(len(rows))[:, None]
            for _ in range(int(np.log2(self.leaf.shape[1]))):
                node = 2 * node + 1 + (bins[line, self.feature[trees, node]] > self.cut[trees, node])
            total += self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 48, rate: float = 0.15, ridge: float = 2.0) -> Trees:
    """Boosting on the logistic loss. Without two kinds of labels the score is constant."""
    inner, leaves = 2**depth - 1, 2**depth
    mean = float(labels.mean()) if len(labels) else 0.5
    start = float(np.log((mean * len(labels) + 0.5) / ((1 - mean) * len(labels) + 0.5)))
    if len(np.unique(labels)) < 2:
        return Trees([np.empty(0)] * rows.shape[1], np.empty((0, inner), np.int64), np.empty((0, inner), np.int64), np.empty((0, leaves)), start)
    edges = [np.unique(np.quantile(rows[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(rows.shape[1])]
    model = Trees(edges, np.empty((0, inner), np.int64), np.empty((0, inner), np.int64), np.empty((0, leaves)), start)
    codes = model.binned(rows).astype(np.int64)
    wide = bins + 1
    total = np.full(len(rows), start)
    features, cuts, values = [], [], []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-total))
        gradient, weight = labels - chance, chance * (1 - chance)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, wide, np.int64)
        node = np.zeros(len(rows), np.int64)
        for level in range(depth):
            low, width = 2**level - 1, 2**level
            place = node - low
            best = np.zeros(width)
            for k in range(rows.shape[1]):
                at = place * wide + codes[:, k]
                g = np.bincount(at, gradient, width * wide).reshape(width, wide).cumsum(axis=1)
                h = np.bincount(at, weight, width * wide).reshape(width, wide).cumsum(axis=1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
                gain[(h < 1) | (h_all - h < 1)] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(width), top]
                better = value > best + 1e-9
                best = np.where(better, value, best)
                feature[low : low + width][better] = k
                cut[low : low + width][better] = top[better]
            node = 2 * node + 1 + (codes[np.arange(len(rows)), feature[node]] > cut[node])
        place = node - inner
        leaf = rate * np.bincount(place, gradient, leaves) / (np.bincount(place, weight, leaves) + ridge)
        total += leaf[place]
        features.append(feature)
        cuts.append(cut)
        values.append(leaf)
    return Trees(edges, np.array(features), np.array(cuts), np.array(values), start)


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = 40_000) -> Trees:
    """Fit on the labelled rows of ``stats``, about ``rows`` at most, chosen by a hash of the id.

    Rows without an id or label, and labels other than 0 and 1, are left out. A document
    with several labels counts once for each.
    """
    given = labels.select(F.col("doc_id").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(
        "doc_id is not null and label in (0, 1)"
    )
    sample = hashed_sample(given, F.col("doc_id"), rows).join(stats, "doc_id").toPandas()
    sample = sample.sort_values(["doc_id", "label"], kind="stable")
    values = np.array(sample["statistics"].tolist(), np.float32).reshape(len(sample), len(STATISTICS))
    return fit(values, sample["label"].to_numpy(float))


def score(stats: DataFrame, model: Trees, threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` of each row of ``stats``."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = np.array(batch["statistics"].tolist(), np.float32).reshape(len(batch), len(STATISTICS))
            points = model.score(rows)
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "score": points, "predicted": (points >= threshold).astype(np.int32)})

    known = stats.select(known_id(F.col("doc_id")).alias("doc_id"), "statistics")
    return restored(known.mapInPandas(walk, "doc_id long, score double, predicted int"))


def stored_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text_statistics``, computed once: training and scoring both read it."""
    return stored(text_statistics(docs, id_col, text_col), "statistics")
