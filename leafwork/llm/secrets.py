"""Secret scan: fixed patterns, and character Markov models for what they miss.

Fixed patterns find assignments, access ids and long hexadecimal runs. Two first-order
character models, one of random strings and one of ordinary identifiers, are trained
from labelled samples; a long run of identifier characters whose log-likelihood ratio
is high enough is reported as a further span of kind ``markov``. Everything is a
DataFrame expression: a text is cut at its matches, and the lengths of the pieces give
the positions, so nothing is shuffled but the transition counts.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import hashed_sample

# Fixed patterns; the last group is the value that must be long enough.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST = 16  # characters that are scored
RUN = r"[A-Za-z0-9+/_=-]{16,}"
WORD = r"[A-Za-z0-9+/_=-]{4,}"
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
_K = len(ALPHABET) + 1  # all other characters share the first place

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Matches of a pattern whose ``group`` has ``least`` characters, with their places."""
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    zipped = F.arrays_zip(pieces.alias("piece"), hits.alias("hit"), values.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        good = F.length(x["value"]) >= least
        return F.struct(
            end.alias("at"),
            F.when(good, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).cast(_SPAN).alias("found"),
        )

    zero = F.expr(f"named_struct('at', 0, 'found', cast(array() as {_SPAN}))")
    found = F.aggregate(zipped, zero, step, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start, then kind; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(
        F.concat(_spans(text, ASSIGN, 0, 2, 12), _spans(text, ACCESS, 1, 0, 18), _spans(text, HEX, 2, 0, 16))
    )


def labelled_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 4000) -> DataFrame:
    """``token, random`` from about ``rows`` documents: values of fixed-pattern matches
    are random strings, all other words of four or more characters are ordinary."""
    sample = hashed_sample(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), F.col("_id"), rows)
    spans = F.transform(base_spans(F.col("_text")), lambda s: s["value"])
    secret = sample.select(F.explode(spans).alias("token"), F.lit(True).alias("random"))
    plain = F.filter(
        F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)),
        lambda w: ~F.exists(F.col("_found"), lambda s: F.contains(s, w) | F.contains(w, s)),
    )
    words = sample.withColumn("_found", spans).select(F.explode(plain).alias("token"), F.lit(False).alias("random"))
    return secret.unionByName(words)


def train(samples: DataFrame, token_col: str = "token", label_col: str = "random") -> list[float]:
    """Log ratio of the transition probabilities (random over ordinary), row by row.

    Rare transitions fall back to single characters, and a class without samples is a
    uniform model. Null tokens and labels are left out. The table has one entry per pair of
    characters, whatever the samples' size.
    """
    token = F.col("_token")
    pairs = (
        samples.select(F.col(token_col).alias("_token"), F.col(label_col).cast("boolean").alias("_random"))
        .where("_token is not null and _random is not null and length(_token) > 1")
        .select(
            "_random",
            F.explode(F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substr(token, i, F.lit(2)))).alias("_pair"),
        )
        .groupBy("_random", "_pair")
        .count()
    )
    counts = {label: [[0.0] * _K for _ in range(_K)] for label in (True, False)}
    place = {c: i for i, c in enumerate(ALPHABET, 1)}
    # Pairs of known characters only come from a closed alphabet of 67 x 67.
    known = pairs.where(F.col("_pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$"))
    for row in known.toLocalIterator():
        counts[row["_random"]][place[row["_pair"][0]]][place[row["_pair"][1]]] += row["count"]
    rates = {label: _log_rates(m) for label, m in counts.items()}
    return [round(rates[True][a][b] - rates[False][a][b], 6) for a in range(_K) for b in range(_K)]


def _log_rates(counts: list[list[float]], weight: float = 10.0) -> list[list[float]]:
    """Transition probabilities, drawn to how often the second character occurs at all."""
    single = [sum(line[b] for line in counts) + 0.5 for b in range(_K)]
    whole = sum(single)
    return [
        [math.log((line[b] + weight * single[b] / whole) / (sum(line) + weight)) for b in range(_K)] for line in counts
    ]


def markov_score(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token's transitions under the two models."""
    ratios = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")

    def step(acc: Column, char: Column) -> Column:
        place = F.instr(F.lit(ALPHABET), char)
        ratio = F.get(ratios, acc["last"] * _K + place)
        return F.struct(
            place.alias("last"),
            (acc["sum"] + F.when(acc["last"] < 0, F.lit(0.0)).otherwise(ratio)).alias("sum"),
        )

    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.split(token, ""), zero, step, lambda acc: acc["sum"])


def _rest(run: Column, taken: Column) -> Column:
    """The parts of a run outside the spans it meets that are long enough to be scored."""
    inside = lambda p: F.exists(taken, lambda b: (b["start"] <= p) & (p < b["end"]))
    starts = F.array_distinct(F.concat(F.array(run["start"]), F.transform(taken, lambda b: b["end"])))

    def part(p: Column) -> Column:
        after = F.transform(F.filter(taken, lambda b: b["start"] >= p), lambda b: b["start"])
        end = F.coalesce(F.array_min(after), run["end"])
        value = F.substring(run["value"], p - run["start"] + 1, end - p)
        return F.struct(p.alias("start"), run["kind"].alias("kind"), end.alias("end"), value.alias("value"))

    parts = F.transform(F.filter(starts, lambda p: (p < run["end"]) & ~inside(p)), part)
    return F.filter(parts, lambda s: s["end"] - s["start"] >= LEAST)


def find_secrets(
    docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 12.0
) -> DataFrame:
    """``doc_id, base, spans`` per row: arrays of (start, kind, end, value).

    ``kind`` is a position in ``KINDS``; places are code points, the end exclusive.
    Spans found by the models never overlap those of the fixed patterns: a run that does
    is cut, and what is long enough of it is scored. Null and empty texts have no spans;
    repeated rows give repeated rows, an empty table none.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = found.withColumn("base", base_spans(F.col("_text"))).withColumn("_runs", _spans(F.col("_text"), RUN, 3, 0, LEAST))
    overlaps = lambda r: F.filter("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
    free = F.flatten(F.transform("_runs", lambda r: F.when(F.size(overlaps(r)) == 0, F.array(r)).otherwise(_rest(r, overlaps(r)))))
    random = F.filter(free, lambda r: markov_score(r["value"], model) >= threshold)
    return found.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
