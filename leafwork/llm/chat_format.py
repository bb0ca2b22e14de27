"""Chat formatting: typed content parts flattened into one marked string per conversation.

A message is a list of typed parts. The visitor turns each part into text: text parts
are escaped, image, audio and document parts become a placeholder in their place, and
leave a reference and the number of tokens the placeholder will expand to. Turns are
framed by control strings; the same strings inside texts and roles are escaped with
``~`` and one letter, and ``~`` itself with ``~0``, so reading back gives every text
exactly. The loss mask lists the assistant's texts as character ranges.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUDIO]", "document": "[DOC]"}
OTHER = "[PART]"
FRAMES = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
ROLE, ROLE_END, TURN_END = "[ROLE]", "[/ROLE]", "[END]"
CONTROL = [
    *(mark for frame in FRAMES.values() for mark in frame),
    ROLE, ROLE_END, TURN_END, *PLACEHOLDERS.values(), OTHER,
]
CODES = dict(zip(CONTROL, "abcdefghijklmnopqrstuvwxyz", strict=False))
_TURN = "(?s)" + "|".join(
    [f"{re.escape(a)}.*?{re.escape(z)}" for a, z in FRAMES.values()]
    + [f"{re.escape(ROLE)}.*?{re.escape(TURN_END)}"]
)


def escape(text: Column) -> Column:
    """No control string is left in the result; ``unescape`` gives the text back."""
    out = F.replace(text, F.lit("~"), F.lit("~0"))
    for mark, code in CODES.items():
        out = F.replace(out, F.lit(mark), F.lit("~" + code))
    return out


def unescape(text: Column) -> Column:
    out = text
    for mark, code in CODES.items():
        out = F.replace(out, F.lit("~" + code), F.lit(mark))
    return F.replace(out, F.lit("~0"), F.lit("~"))


def text_part(text: Column) -> Column:
    """A message of one text part."""
    return F.array(F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), text)).cast(
        "array<struct<type:string,text:string>>"
    )


def _field(part: Column, name: str, kind: str, names: set[str]) -> Column:
    return part[name].cast(kind) if name in names else F.lit(None).cast(kind)


def visited(parts: Column, names: set[str], patch: int, audio_rate: float, page_tokens: int) -> Column:
    """One struct per part: its text or placeholder, and what is attached."""

    def visit(part: Column) -> Column:
        kind = F.coalesce(part["type"], F.lit("other"))
        side = lambda name: F.ceil(F.coalesce(_field(part, name, "double", names), F.lit(1.0)) / patch)
        body = F.when(kind == "text", escape(F.coalesce(_field(part, "text", "string", names), F.lit(""))))
        for name, mark in PLACEHOLDERS.items():
            body = body.when(kind == name, F.lit(mark))
        tokens = (
            F.when(kind == "text", F.lit(0))
            .when(kind == "image", side("width") * side("height"))
            .when(kind == "audio", F.ceil(F.coalesce(_field(part, "seconds", "double", names), F.lit(0.0)) * audio_rate))
            .when(kind == "document", F.coalesce(_field(part, "pages", "int", names), F.lit(1)) * page_tokens)
            .otherwise(F.lit(1))
        )
        return F.struct(
            body.otherwise(F.lit(OTHER)).alias("body"),
            kind.alias("type"),
            _field(part, "ref", "string", names).alias("ref"),
            tokens.cast("long").alias("tokens"),
        )

    return F.transform(parts, visit)


def format_chats(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    patch: int = 14,
    audio_rate: float = 25.0,
    page_tokens: int = 1024,
) -> DataFrame:
    """``conv_id, formatted, loss_spans, attachments, expanded_tokens`` per conversation.

    Turns are ordered by number, then role and text; equal rows stay separate turns.
    ``loss_spans`` are (start, length) in code points of ``formatted``. Attachments are
    numbered in reading order. A null role is an empty one, a null text part is empty,
    a null part list or a null text gives an empty turn, an unknown type takes the
    general placeholder. Rows without a conversation id form one conversation. A
    conversation is one value here by nature; nothing larger is ever gathered.
    """
    kind = messages.schema[parts_col].dataType
    parts, names = F.coalesce(F.col(parts_col), F.array().cast(kind)), set(kind.elementType.names)
    seen = messages.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        visited(parts, names, patch, audio_rate, page_tokens).alias("seen"),
    )
    head = F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(ROLE_END))
    tail = F.lit(TURN_END)
    for role, (a, z) in FRAMES.items():
        head = F.when(F.col("role") == role, F.lit(a)).otherwise(head)
        tail = F.when(F.col("role") == role, F.lit(z)).otherwise(tail)
    turns = seen.select(
        "conv_id",
        F.struct(
            "turn", "role",
            F.array_join(F.transform("seen", lambda p: p["body"]), "").alias("body"),
            head.alias("head"), tail.alias("tail"),
            F.filter("seen", lambda p: p["type"] != "text").alias("attached"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    size = lambda t: F.length(t["head"]) + F.length(t["body"]) + F.length(t["tail"])
    spans = F.aggregate(
        "turns",
        F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,length:bigint>>))"),
        lambda s, t: F.struct(
            (s["at"] + size(t)).cast("long").alias("at"),
            F.when(
                t["role"] == "assistant",
                F.concat(
                    s["spans"],
                    F.array(F.struct(
                        (s["at"] + F.length(t["head"])).cast("long").alias("start"),
                        F.length(t["body"]).cast("long").alias("length"),
                    )),
                ),
            ).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    attached = F.flatten(F.transform("turns", lambda t: t["attached"]))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], t["tail"])), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.transform(attached, lambda p, i: F.struct(i.alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda s, p: s + p["tokens"]).alias("expanded_tokens"),
    )


def read_chats(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""

    def turn(raw: Column) -> Column:
        named = F.substring_index(F.substring(raw, len(ROLE) + 1, 1 << 30), ROLE_END, 1)
        role, text = unescape(named), raw
        start = F.length(named) + len(ROLE) + len(ROLE_END)
        inner = F.substr(raw, start + 1, F.length(raw) - start - len(TURN_END))
        for name, (a, z) in FRAMES.items():
            framed = F.startswith(raw, F.lit(a))
            role = F.when(framed, F.lit(name)).otherwise(role)
            inner = F.when(framed, F.substr(raw, F.lit(len(a) + 1), F.length(raw) - len(a) - len(z))).otherwise(inner)
        text = unescape(inner)
        return F.struct(role.alias("role"), text.alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def masked_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(
        F.transform(loss_spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
