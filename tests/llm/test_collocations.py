"""Phrase mining: automata against plain counting, results against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from leafwork.llm import collocations
from leafwork.llm.count_automaton import BITS, Automaton, word_array

SCHEMA = "doc_id long, text string, lang string, score int, a string, n double, phrase string, _slice int, range int"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, lang, 1, "a", 1.0, "p", 2, 3) for k, (t, lang) in enumerate(rows)], SCHEMA)


def brute(rows, least=10, k=2000):
    counts, words = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for size in (1, 2, 3):
                counts.update((lang, tuple(w[i : i + size])) for i in range(len(w) - size + 1))
    out = []
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least:
            cuts = [(1_000_000 * a * a // (counts[lang, p[:j]] * counts[lang, p[j:]]), j) for j in range(1, len(p))]
            score, j = min(cuts)
            longer = (f for (o, q), f in counts.items() if o == lang and len(q) == 3 and f >= least and len(p) == 2 and p in (q[:2], q[1:]))
            if not any(100 * f >= 50 * a for f in longer):
                out.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:j]], counts[lang, p[j:]]))
    result, seen = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= k:
            result.append((lang, seen[lang], phrase.decode(), -a, left, right, words[lang], -score))
    return result


def random_rows(rng, n, vocabulary):
    marks = ["", "", "", "", ",", ".", "!", "\n", "\r\n", ";"]
    return [
        (" ".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "de", None]))
        for _ in range(n)
    ]


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("shard_words", [50, 1_000_000])
def test_equals_brute_force(spark, shard_words):
    rng = random.Random(4)
    rows = random_rows(rng, 250, ["The", "the", "of", "zeit", "a", "über", "\x1c", "b\x85c", "x's", "new", "york", " "])
    rows += [("New York city\tis  NEW york, new york", "en")] * 30 + [(None, "en"), ("", "de"), (" \t ", None), ("?!.,", "en"), ("one", "fr"), ("und so weiter", "und")] * 2
    want = brute(rows)
    assert len(want) > 50
    df = frame(spark, rows).repartition(5)
    assert got(collocations.collocations(df, shard_words=shard_words, range_bytes=500)) == sorted(want)
    assert got(collocations.collocations(df, shard_words=shard_words, least=3, k=7)) == sorted(brute(rows, 3, 7))


def test_empty_tables_and_long_texts(spark):
    assert got(collocations.collocations(frame(spark, []))) == []
    assert got(collocations.collocations(frame(spark, [(None, None), ("", "en")]))) == []
    rows = [("same word " * 300_000, "en"), ("y" * 3_000_000, "en"), ("\xff ÿ " * 20, "x\ny")]
    assert got(collocations.collocations(frame(spark, rows), shard_words=70_000)) == sorted(brute(rows))


def keyed(counts):
    """Sorted keys, counts and words of a table of phrases."""
    words = sorted({w for p in counts for w in p})
    number = {w: i + 1 for i, w in enumerate(words)}
    keys = {sum(number[w] << (BITS * (2 - d)) for d, w in enumerate(p)): n for p, n in counts.items()}
    order = sorted(keys)
    return np.array(order, np.int64), np.array([keys[k] for k in order], np.int64), word_array(words)


def table(automaton):
    words = automaton.words.to_pylist()
    rows, counts = automaton.phrases()
    return {tuple(words[i] for i in row if i >= 0): n for row, n in zip(rows.tolist(), counts.tolist(), strict=True)}


def test_automata_keep_add_and_look_up_counts():
    import pyarrow as pa

    rng = random.Random(6)
    for trial in range(60):
        alphabet = [bytes([97 + k]) * rng.randint(1, 3) for k in range(rng.choice((1, 3, 8)))]
        parts = [
            Counter({tuple(rng.choices(alphabet, k=rng.randint(1, 3))): rng.choice((1, 1, 2, 300, 1 << 40)) for _ in range(rng.randint(0, 60))})
            for _ in range(rng.randint(1, 5))
        ]
        built = [Automaton.from_sorted(*keyed(p)) for p in parts]
        assert [table(b) for b in built] == [dict(p) for p in parts]
        read = [Automaton.load(b.dump()) for b in built]
        assert [table(r) for r in read] == [dict(p) for p in parts]
        whole, total = Automaton.union(read), sum(parts, Counter())
        assert table(whole) == dict(total)
        assert table(Automaton.load(whole.at_least(3).dump())) == {p: n for p, n in total.items() if n >= 3}
        asked = [tuple(rng.choices([*alphabet, b"none"], k=rng.randint(1, 2))) for _ in range(40)]
        columns = [pa.array([p[d] if d < len(p) else None for p in asked], pa.large_binary()) for d in range(2)]
        assert whole.compose(columns).tolist() == [total[p] for p in asked]
