"""Column functions over titles, file names and topic text.

All of them are built-in expressions, so they stay on the JVM and can be
evaluated in the scan stage: a topic's content never has to be shuffled to
obtain its title.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that trimming and splitting must honour.
# Spark's trim() strips U+0020 only, and Java's \s is ASCII.
WHITE = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{WHITE}]"

# Defaults and templates.
DEFAULT_TOPICS_DIR = "topics"
DEFAULT_IMAGES_DIR = "images"
DEFAULT_INSTANCE_NAME = "Untitled"
STUB_BODY = "\n\nContent goes here..."


def trim_ws(c: Column) -> Column:
    """Trim every kind of Unicode white space on both sides."""
    return F.regexp_replace(c, f"\\A{WS}+|{WS}+\\z", "")


def non_empty(c: Column) -> Column:
    """NULL for the empty string."""
    return F.nullif(c, F.lit(""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Directory part of a path; ``.`` when there is none."""
    cut = F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1)
    return (
        F.when(~F.contains(path, F.lit("/")), F.lit("."))
        .when(cut == "", F.lit("/"))
        .otherwise(cut)
    )


def file_label(file: Column) -> Column:
    """Title shown for a topic that has none: its file name in angle brackets."""
    return F.concat(F.lit("<"), base_name(file), F.lit(">"))


def heading(content: Column) -> Column:
    """Text of the leading level-one heading, NULL when there is none.

    Only the first non-blank line counts, and the hash needs a space after it.
    """
    raw = F.regexp_extract(content, f"\\A{WS}*# ([^\\n]*)", 1)
    return non_empty(trim_ws(raw))


def topic_title(content: Column, file: Column) -> Column:
    """Title of a topic; a missing file (NULL content) takes the fallback."""
    return F.coalesce(heading(content), file_label(file))


def set_title(content: Column, title: Column) -> Column:
    """Replace the heading line, or put one in front when there is none."""
    head = F.regexp_extract(content, f"\\A{WS}*# [^\\n]*", 0)
    blank_lines = F.regexp_extract(head, f"\\A(?:{WS}*\\n)?", 0)
    rest = F.substring(content, F.length(head) + 1, F.length(content))
    line = F.concat(F.lit("# "), title)
    return F.when(heading(content).isNotNull(), F.concat(blank_lines, line, rest)).otherwise(
        F.concat(line, F.lit("\n"), content)
    )


def dashed(text: Column) -> Column:
    """Lower-cased text with every white-space run turned into one dash."""
    return F.regexp_replace(F.lower(text), f"{WS}+", "-")


def slug(title: Column) -> Column:
    """File name for a topic title."""
    return F.concat(dashed(trim_ws(title)), F.lit(".md"))


def start_page_file(title: Column) -> Column:
    """File name of a new instance's first topic (not trimmed)."""
    return F.concat(dashed(title), F.lit(".md"))


def about_title(title: Column) -> Column:
    return F.concat(F.lit("About "), title)


def numbered_file(title: Column, n: Column) -> Column:
    """The n-th alternative file name for a title."""
    return F.concat(dashed(title), n.cast("string"), F.lit(".md"))


def default_instance_id(title: Column) -> Column:
    """Lower-cased initials of the words of a title."""
    words = F.split(title, f"{WS}+")
    return F.array_join(F.transform(words, lambda w: F.lower(F.left(w, F.lit(1)))), "")


def instance_name(name: Column, instance_id: Column) -> Column:
    return F.coalesce(non_empty(name), non_empty(instance_id), F.lit(DEFAULT_INSTANCE_NAME))


def live_title(content: Column, file: Column) -> Column:
    """Title while a topic is open: the hash needs no space, ``##`` is no title.

    NULL when the first non-blank line is not a heading of that kind.
    """
    line = F.regexp_extract(content, f"\\A{WS}*([^{WHITE}][^\\n]*)", 1)
    is_title = line.startswith("#") & ~line.startswith("##")
    text = non_empty(trim_ws(F.substring(line, F.lit(2), F.length(line))))
    return F.when(is_title, F.coalesce(text, base_name(file)))


def saved_title(content: Column) -> Column:
    """Title compared on save: ``''`` without a heading, NULL for a blank file."""
    blank = ~F.regexp_like(content, F.lit(f"[^{WHITE}]"))
    return F.when(~blank, F.coalesce(heading(content), F.lit("")))


def stub(title: Column) -> Column:
    """Content of a freshly created topic."""
    return F.concat(F.lit("# "), title, F.lit(STUB_BODY))
