"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs, a digit
before a dot, URL schemes and identifier cues. From each anchor a small deterministic
parser expands to the left and right and validates what it found. Card numbers have no
anchor but their digits and are parsed from each first digit of a run. The four base
kinds equal leftmost non-overlapping matches of their patterns with failing ones
dropped; ``url`` (with a user or query part) and ``account`` spans come from schemes
and cues and never overlap a base span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "url", "account")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("iban", "account", "acct", "ssn", "passport", "konto", "compte", "cuenta", "customer id", "member id", "user id")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_DIGITS = re.compile(r"[0-9][\x20-]?[0-9](?:[\x20-]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9._~:/?#@!$&'*+,;=%-]+")
_ACCOUNT = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|num|id))?\x20*[:=#]?\x20*([A-Z]{0,2}[0-9](?:[\x20-]?[A-Z0-9]){5,33})", re.I)
# Lower case of A-Z only, so that places stay the same.
_FOLD = {c: c + 32 for c in range(65, 91)}
_AUTOMATON = None


def _automaton() -> ahocorasick.Automaton:
    global _AUTOMATON
    if _AUTOMATON is None:
        made = ahocorasick.Automaton()
        for word in ("@", "+", *(f"{d}." for d in range(10)), *SCHEMES, *CUES):
            made.add_word(word, word)
        made.make_automaton()
        _AUTOMATON = made
    return _AUTOMATON


def _luhn(digits: str) -> bool:
    total = 0
    for k, char in enumerate(reversed(digits)):
        value = ord(char) - 48
        if k % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _digit_starts(text: str, dots: list[int]) -> list[int]:
    """The first digit of each run of digits that a digit-dot anchor ends."""
    starts = []
    for at in dots:
        start, floor = at, starts[-1] if starts else -1
        while start > floor + 1 and "0" <= text[start - 1] <= "9":
            start -= 1
        starts.append(start)
    return starts


def find(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all spans, by kind as listed, then start."""
    ats, pluses, dots, schemes, cues = [], [], [], [], []
    for end, word in _automaton().iter(text.translate(_FOLD)):
        start = end - len(word) + 1
        if word == "@":
            ats.append(start)
        elif word == "+":
            pluses.append(start)
        elif word[-1] == ".":
            dots.append(start)
        elif word in SCHEMES:
            schemes.append(start)
        else:
            cues.append((start, end + 1))
    emails, ips, phones = [], [], []
    last = 0
    for at in ats:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            emails.append((0, start, last))
    last = 0
    for start in _digit_starts(text, dots):
        if start >= last and (found := _IP.match(text, start)):
            last = found.end()
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found.groups()):
                ips.append((1, start, last))
    cards = []
    for found in _DIGITS.finditer(text):
        digits = found[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            cards.append((2, *found.span()))
    last = 0
    for start in pluses:
        if start >= last and (found := _PHONE.match(text, start)):
            last = found.end()
            if 8 <= sum("0" <= c <= "9" for c in found[0]) <= 15:
                phones.append((3, start, last))
    base = emails + ips + cards + phones
    if not schemes and not cues:
        return base
    taken = [(a, z) for _, a, z in base]
    extra, last = [], 0
    for start in schemes:
        found = _URL.match(text, start)
        if found and start >= last and ("@" in found[0] or "?" in found[0]):
            span = (start, start + len(found[0].rstrip(".,;:!?'")))
            last = span[1]
            extra.append((4, *span))
    last = 0
    for _, end in cues:
        if end >= last and (found := _ACCOUNT.match(text, end)) and sum(c.isdigit() for c in found[1]) >= 5:
            last = found.end(1)
            extra.append((5, *found.span(1)))
    return base + _free(extra, taken)


def _free(extra: list[tuple[int, int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Spans that overlap none of ``taken``; a sweep over both in order of place."""
    out, ordered, k, reach = [], sorted(taken), 0, 0
    for kind, start, end in sorted(extra, key=lambda s: s[1]):
        while k < len(ordered) and ordered[k][0] < end:
            reach = max(reach, ordered[k][1])
            k += 1
        if reach <= start:
            out.append((kind, start, end))
    return sorted(out)


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` per row; spans are (kind, start, end), places in code points.

    ``kind`` is a position in ``KINDS``, the end is exclusive. Null and empty texts have
    no spans; repeated rows give repeated rows, an empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    @F.pandas_udf("array<struct<kind:int,start:int,end:int>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(
                [[{"kind": k, "start": a, "end": z} for k, a, z in find(t)] for t in texts], dtype=object
            )

    return rows.select("doc_id", spans("_text").alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
