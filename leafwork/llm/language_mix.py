"""Language identification as a mixture model.

Every language is a distribution over hashed character trigrams of letters, counted
over all labelled documents. A text is cut into short segments; each has a likelihood
under every language, and expectation-maximisation finds the text's proportions. The
set of languages is chosen by penalised likelihood: starting from all, the weakest is
dropped as long as the Bayesian information criterion gets better. A batch of texts
is worked on at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import known_id, restored

BUCKETS = 1 << 14
SEGMENT = 24  # trigrams
UNKNOWN = "und"
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point its lower case, or 0 if it is no letter."""
    global _LETTERS
    if _LETTERS is None:
        table = np.zeros(0x110000, np.uint32)
        for code in range(0x110000):
            char = chr(code)
            if char.isalpha():
                low = char.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _LETTERS = table
    return _LETTERS


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts in a row, and how many each text has.

    Runs of anything but letters count as one blank; trigrams of which the middle is
    blank are left out.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = _letters()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]
    if not len(codes):
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    ends = np.zeros(len(codes) + 1, bool)
    ends[0] = ends[-1] = True
    ends[1:-1] = owner[1:] != owner[:-1]
    left = np.where(ends[:-1], 0, np.r_[np.uint32(0), codes[:-1]])
    right = np.where(ends[1:], 0, np.r_[codes[1:], np.uint32(0)])
    here = codes != 0
    mixed = (left[here].astype(np.uint64) * np.uint64(0x9E3779B1) + codes[here]) * np.uint64(0x85EBCA6B) + right[here]
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(50)).astype(np.int64), np.bincount(owner[here], minlength=len(texts))


@dataclass(frozen=True)
class LanguageModel:
    """``log_rates``: one row per bucket, one column per language."""

    languages: list[str]
    log_rates: np.ndarray


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_languages: int = 500) -> LanguageModel:
    """Count trigrams by language over all rows with a text and a language.

    What comes to the driver is one number per language and bucket; more languages than
    ``max_languages`` are an error, not a cut.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        "text is not null and lang is not null"
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang", sort=False)["text"]:
                values = part.tolist()
                total = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for at in range(0, len(values), 256):
                    total += np.bincount(trigrams(values[at : at + 256])[0], minlength=BUCKETS)
        for lang, total in held.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": total[at]})

    counts = rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # One row per language, as a map of at most BUCKETS entries.
    found = counts.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    learned = sorted(found.limit(max_languages + 1).collect(), key=lambda r: r["lang"])
    if len(learned) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages")
    rates = np.full((BUCKETS, len(learned)), 0.05)
    for k, row in enumerate(learned):
        np.add.at(rates[:, k], np.array(row["bucket"], np.int64), row["n"])
    return LanguageModel([r["lang"] for r in learned], np.log(rates / rates.sum(axis=0)).astype(np.float32))


def _mixtures(likes: np.ndarray, owner: np.ndarray, texts: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) and which languages are in each text's set.

    ``likes``: segments x languages, scaled so that the largest of a row is 1. ``owner``
    is sorted and every text owns at least one segment.
    """
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    sizes = np.bincount(owner, minlength=texts).astype(float)

    def fit(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shares = member / member.sum(axis=1, keepdims=True)
        for _ in range(rounds):
            weighted = likes * shares[owner]
            total = np.maximum(weighted.sum(axis=1, keepdims=True), 1e-300)
            shares = np.add.reduceat(weighted / total, first, axis=0) / sizes[:, None]
        total = np.maximum((likes * shares[owner]).sum(axis=1), 1e-300)
        return shares, np.add.reduceat(np.log(total), first)

    member = np.ones((texts, likes.shape[1]), bool)
    shares, fitness = fit(member)
    penalty = np.log(np.maximum(sizes, 2)) / 2
    # Languages without any weight go at once; then one after the other.
    member = shares > 1e-6
    shares, fitness = fit(member)
    for _ in range(likes.shape[1] - 1):
        size = member.sum(axis=1)
        weakest = np.where(member, shares, np.inf).argmin(axis=1)
        less = member.copy()
        less[np.arange(texts), weakest] = size == 1
        fewer_shares, fewer_fitness = fit(less)
        better = (size > 1) & (fewer_fitness + penalty >= fitness)
        if not better.any():
            break
        member = np.where(better[:, None], less, member)
        shares = np.where(better[:, None], fewer_shares, shares)
        fitness = np.where(better, fewer_fitness, fitness)
    return shares, member


def mixtures(texts: list[str], model: LanguageModel, rounds: int = 20) -> np.ndarray:
    """Language proportions of each text; all zero if it has no letters."""
    out = np.zeros((len(texts), len(model.languages)))
    grams, counts = trigrams(texts)
    some = np.flatnonzero(counts)
    if not len(some) or not model.languages:
        return out
    counts = counts[some]
    starts = np.cumsum(counts) - counts
    # Segments of equal size within a text; a short rest joins the last one.
    pieces = np.maximum(1, counts // SEGMENT)
    owner = np.repeat(np.arange(len(some)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    logs = np.add.reduceat(model.log_rates[grams], starts[owner] + number * SEGMENT, axis=0).astype(np.float64)
    likes = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -60))
    out[some], _ = _mixtures(likes, owner, len(some), rounds)
    return out


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, languages``: the largest proportion, and the set chosen.

    Null texts and texts without letters, or a model without languages, give ``und``
    with score 0 and an empty set. Ties take the first language by name.
    """
    rows = docs.select(known_id(F.col(id_col)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = np.array([*model.languages, UNKNOWN], object)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _by_size(batch):
                shares = mixtures(part["text"].tolist(), model)
                if not model.languages:
                    best, score = np.zeros(len(part), np.int64), np.zeros(len(part))
                else:
                    best, score = shares.argmax(axis=1), shares.max(axis=1)
                best = np.where(score > 0, best, len(names) - 1)
                sets = [[{"lang": names[k], "share": float(s[k])} for k in np.argsort(-s, kind="stable") if s[k] > 0] for s in shares]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].array, "lang_pred": names[best],
                    "score": np.clip(score, 0, 1), "languages": sets,
                })

    kinds = "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    return restored(rows.mapInPandas(predict, kinds))


def _by_size(batch: pd.DataFrame, chars: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Runs of rows with about ``chars`` characters, one row at least."""
    if len(batch):
        run = np.cumsum(batch["text"].str.len().to_numpy(np.int64)) // chars
        for _, part in batch.groupby(run, sort=True):
            yield part
