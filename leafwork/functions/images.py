"""Rewriting of image references, for HTML tags and for Markdown images.

Both split a text at the matches, rewrite each match and zip the pieces
together again: one pass over whole texts, inside built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafwork.functions.arrays import bind
from leafwork.functions.paths import posix_join

# Fixed value: an <img> tag with a quoted src attribute.
IMG_TAG = r"""(?i)<img\s+([^>]*src\s*=\s*["'])([^"']+)(["'][^>]*)>"""


def _balanced(opening: str, plain: str, closing: str, levels: int) -> str:
    """Text of ``plain`` parts in which brackets pair up, nested to ``levels``."""
    pattern = f"(?:{plain})*+"
    for _ in range(levels):
        pattern = f"(?:{plain}|{opening}{pattern}{closing})*+"
    return pattern


# Markdown constructs in the order they take precedence: fenced blocks (closed by the
# same character, at least as often, or by the end of the quote or list item they are in),
# indented blocks after a blank line, code spans, then inline images with a bracketed or
# bare destination, and link definitions. What is matched and is no image or definition
# stays as it is.
_FENCE = (
    r"(?m:^) {0,3}(?:(?<tick>`{3,})[^`\n]*|(?<wave>~{3,})[^\n]*)"
    r"(?:\n[\s\S]*?)??(?:\n {0,3}(?:\k<tick>`*|\k<wave>~*)[ \t]*(?=\n|\z)|\z)"
)


def _fence_in(start: str, line: str, mark: str, name: str) -> str:
    """A fenced block whose first line has ``start`` before it, and whose lines begin with ``line``."""
    end = rf"\k<{name}>{mark}*[ \t]*(?=\n|\z)"
    return rf"(?m:^){start}(?<{name}>{mark}{{3,}})[^{mark}\n]*(?:\n(?!{line}{end})(?:{line}[^\n]*))*+(?:\n{line}{end})?"


_QUOTE = r" {0,3}>(?:[ \t]?>)*+ {0,4}"
_ITEM = r" {0,3}(?:[-*+]|[0-9]{1,9}[.)])[ \t]{1,4}"
_INSIDE = "|".join(
    _fence_in(start, line, mark, f"{name}{kind}")
    for name, start, line in (("quote", _QUOTE, _QUOTE), ("item", _ITEM, r"(?:[ \t]{2,}|(?=\n|\z))"))
    for kind, mark in (("tick", "`"), ("wave", "~"))
)
_INDENTED = r"(?:\A|(?m:^)[ \t]*\n)(?:(?: {4}|\t)[^\n]*(?:\n|\z))+"
_CODE_SPAN = r"``(?<!```)(?!`)[\s\S]*?[^`]``(?!`)|`(?<!``)(?!`)[^`]+`(?!`)"
# Brackets and parentheses count if they pair up.
_ALT = r"!\[" + _balanced(r"\[", r"[^\[\]\\]++|\\[\s\S]", r"\]", 16) + r"\]"
_END = r"(?:[ \t]+(?:\"[^\"]*\"|'[^']*'))?[ \t]*\)"
_BARE = r"(?=[^\s)<>])" + _balanced(r"\(", r"[^\s()<>]++", r"\)", 16)
_IMAGE = r"(?<!(?<!\\)\\)" + _ALT + r"\([ \t]*(?:<[^>\n]*>|" + _BARE + ")" + _END
_DEFINITION = r"(?m:^) {0,3}\[[^\]\n]+\]:[ \t]*[^\s<>]+"
MD_TOKEN = f"{_INSIDE}|{_FENCE}|{_INDENTED}|{_CODE_SPAN}|{_IMAGE}|{_DEFINITION}"
_MD_PARTS = f"({_ALT}" + r"\([ \t]*<?)(" + _BARE + r"|(?<=<)[^>\n]+)([\s\S]*)"
_DEF_PARTS = r"( {0,3}\[([^\]\n]+)\]:[ \t]*)([^\s<>]+)"
# Images that name a definition: its label, or the text if the label is left out.
_LABELLED = r"(?<!(?<!\\)\\)!\[([^\]\n]*)\](?!\()(?:\[([^\]\n]*)\])?"
# A path that joining leaves as it is.
_PLAIN_PATH = r"\A[^/.][^/]*(?:/[^/.][^/]*)*\z"


def rewrite_matches(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """A text with every match of a pattern changed."""
    pieces = F.split(text, pattern, -1)
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)
    joined = F.zip_with(
        pieces, matches, lambda piece, match: F.concat(piece, F.coalesce(match, F.lit("")))
    )
    return F.array_join(joined, "")


def _below_images(folder: Column, src: Column) -> Column:
    """``../folder/src``, normalised; plain paths take the short way."""
    return F.when(F.regexp_like(src, F.lit(_PLAIN_PATH)), F.concat(posix_join(F.lit(".."), folder), F.lit("/"), src)).otherwise(
        posix_join(F.lit(".."), folder, src)
    )


def rewrite_html_images(html: Column, images_folder: Column) -> Column:
    """Point relative ``<img src>`` values at the images folder next to the topics folder."""
    prefix = posix_join(F.lit(".."), images_folder)

    def change(tag: Column) -> Column:
        def with_src(src: Column) -> Column:
            keep = src.startswith(prefix) | F.regexp_like(src, F.lit(r"(?i)\Ahttps?://"))
            moved = F.concat(
                F.lit("<img "),
                F.regexp_extract(tag, IMG_TAG, 1),
                _below_images(images_folder, src),
                F.regexp_extract(tag, IMG_TAG, 3),
                F.lit(">"),
            )
            return F.when(keep, tag).otherwise(moved)

        return bind(F.regexp_extract(tag, IMG_TAG, 2), with_src)

    return F.when(F.regexp_like(html, F.lit("(?i)<img")), rewrite_matches(html, IMG_TAG, change)).otherwise(html)


def rewrite_markdown_images(text: Column, images_folder: Column) -> Column:
    """The same for Markdown images outside fenced and indented blocks and code spans.

    Covered: ``![alt](src)``, ``![alt](<src>)``, each with an optional title, and the
    definitions ``[label]: src`` that images name (links that name them follow).
    """
    prefix = posix_join(F.lit(".."), images_folder)
    label = lambda m: F.lower(F.coalesce(F.nullif(F.regexp_extract(m, _LABELLED, 2), F.lit("")), F.regexp_extract(m, _LABELLED, 1)))
    named = F.transform(F.regexp_extract_all(text, F.lit(_LABELLED), F.lit(0)), label)

    def moved(token: Column, parts: str, before: int, at: int, after: int | None) -> Column:
        def with_src(src: Column) -> Column:
            keep = (src == "") | src.startswith(prefix) | src.startswith("http")
            rest = [] if after is None else [F.regexp_extract(token, parts, after)]
            new = F.concat(F.regexp_extract(token, parts, before), _below_images(images_folder, src), *rest)
            return F.when(keep, token).otherwise(new)

        return bind(F.regexp_extract(token, parts, at), with_src)

    def with_names(names: Column) -> Column:
        def change(token: Column) -> Column:
            defined = F.regexp_like(token, F.lit(r"\A {0,3}\[")) & F.array_contains(names, F.lower(F.regexp_extract(token, _DEF_PARTS, 2)))
            return (
                F.when(token.startswith("!["), moved(token, _MD_PARTS, 1, 2, 3))
                .when(defined, moved(token, _DEF_PARTS, 1, 3, None))
                .otherwise(token)
            )

        return rewrite_matches(text, MD_TOKEN, change)

    # The names are found once for a text, not once for each token.
    return F.when(F.contains(text, F.lit("![")), bind(F.array_distinct(named), with_names)).otherwise(text)


def in_topics_folder(path: Column, topics_folder: Column) -> Column:
    """True where a path mentions the topics folder's name (a plain substring test)."""
    return F.contains(path, topics_folder)
