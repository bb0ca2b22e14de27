"""Main text of web pages by the container paths that a host's pages agree on.

Each page scores its containers and votes for the path of the best one: tags and classes
from the root down, with numbers generalised. Spark counts the votes of every host, and a
second scan takes from each page what lies at the winning paths; a page that has none of
them falls back on its own best container. Pages are parsed by one regular expression
for tags, with the end tags that HTML lets authors leave out. Nothing is recursive, so
depth is no limit, and no page leaves its task but as its text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import stored

# A comment, a tag (a quoted value holds any character), a tag cut off by the page's end, a declaration.
_TAG = re.compile(
    r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))
      | <(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>
      | </?[A-Za-z].*\Z
      | <[!?/][^>]*(?:>|\Z)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/]|$))""", re.I)
_NUMBERS = re.compile(r"[0-9]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Classes of HTML's elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in "script style textarea title xmp iframe noembed noframes".split()}
_CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr main menu nav ol p pre search section table ul".split()
)
_BLOCK = _CLOSES_P | frozenset("html head body li dt dd tr td th thead tbody tfoot caption option summary legend center".split())
_CONTAINERS = frozenset("body article main section div td center blockquote".split())
# An open element of the first kind ends where one of the second opens, unless the third lies between.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)),
}
_DROPPED = frozenset(
    "head nav footer aside form script style noscript template textarea title select button input iframe svg math"
    " canvas object audio video map dialog menu noembed noframes search".split()
)
# Words of classes, ids and roles that mark what is not the article.
_MARKS = frozenset(
    "nav navbar navigation menu sidebar aside footer ad ads advert adverts advertisement advertising adsense"
    " sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay comment comments"
    " commentlist disqus respond replies social share sharing related recommended recommendations breadcrumb breadcrumbs"
    " pagination pager newsletter subscribe subscription signup login search toolbar copyright complementary contentinfo".split()
)
_HEADER_MARKS = frozenset("header topbar masthead banner".split())
# A class that says that something else has, or has not, such a part.
_ABOUT = frozenset("has have no not with without is".split())
_COMMENT_MARKS = frozenset("comment comments commentlist replies".split())
_ROOMS = frozenset(("html", "body", "main", "article"))


def host_of(url):
    """The host of an address in lower case, without its port; empty where there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.lower(rest)


class Page:
    """The elements of a page in document order, and its runs of text.

    ``runs`` holds (element, text), and (element, None) where a block starts or ends.
    """

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.steps, self.ends = ["#"], [-1], [""], [0]
        self.dropped, self.weak = [False], [0]
        self.runs: list[tuple[int, str | None]] = []
        self._read(source)
        self._settle()

    def _read(self, source: str) -> None:
        stack, at, size = [0], 0, len(source)
        runs, tags = self.runs, self.tags

        def close(depth: int) -> None:
            while len(stack) > depth:
                node = stack.pop()
                self.ends[node] = len(tags)
                if tags[node] in _BLOCK:
                    runs.append((stack[-1], None))

        while at < size:
            found = _TAG.search(source, at)
            if not found:
                runs.append((stack[-1], source[at:]))
                break
            if found.start() > at:
                runs.append((stack[-1], source[at : found.start()]))
            at = found.end()
            if not found[2]:
                continue
            name = found[2].lower()
            if found[1]:
                inline = name not in _BLOCK
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] == name:
                        close(depth)
                        break
                    if inline and tags[stack[depth]] in _BLOCK:
                        break
                continue
            if name in _CLOSES_P:
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] == "p":
                        close(depth)
                        break
                    if tags[stack[depth]] in _BLOCK:
                        break
            if name in _ENDS:
                same, walls = _ENDS[name]
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] in same:
                        close(depth)
                        break
                    if tags[stack[depth]] in walls:
                        break
            if name in _BLOCK:
                runs.append((stack[-1], None))
            if name in _VOID:
                if name == "br":
                    runs.append((stack[-1], " "))
                continue
            node = self._open(name, found[3], stack[-1])
            stack.append(node)
            if name in _RAW:
                end = _RAW[name].search(source, at)
                at = end.start() if end else size
        close(1)
        self.ends[0] = len(tags)

    def _open(self, name: str, attributes: str | None, parent: int) -> int:
        node, step, drop, weak = len(self.tags), name, name in _DROPPED, 2 * (name == "header")
        if attributes:
            words: set[str] = set()
            for key, *values in _ATTRIBUTE.findall(attributes):
                value = html.unescape("".join(values))
                if key.lower() == "class":
                    step += "".join("." + c for c in sorted({_NUMBERS.sub("#", c) for c in value.split()}))
                if key.lower() == "hidden":
                    drop = True
                for token in value.split():
                    parts = {w.lower() for w in _PARTS.findall(token)}
                    if parts.isdisjoint(_ABOUT):
                        words |= parts
            if name not in _ROOMS:
                weak = 2 if weak or not words.isdisjoint(_HEADER_MARKS) else int(not words.isdisjoint(_MARKS))
            elif not words.isdisjoint(_COMMENT_MARKS) and name == "article":
                drop = True
        self.tags.append(name)
        self.parents.append(parent)
        self.steps.append(step)
        self.ends.append(0)
        self.dropped.append(drop)
        self.weak.append(weak)
        return node

    def _settle(self) -> None:
        """Which elements are left out, how much text each holds, and how much of it links."""
        n = len(self.tags)
        held, links, linked = [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            linked[i] = self.tags[i] == "a" or linked[self.parents[i]]
        own, own_linked = [0] * n, [0] * n
        for node, text in self.runs:
            if text:
                size = sum(map(len, text.split()))
                own[node] += size
                if linked[node]:
                    own_linked[node] += size
        total, total_linked, room = own[:], own_linked[:], [0] * n
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            total[p] += total[i]
            total_linked[p] += total_linked[i]
            links[p] += links[i] + (self.tags[i] == "a")
            # A wrapper of the page's main part is not left out for its class; a title alone saves no header.
            holds = 0 if self.dropped[i] else 2 if self.tags[i] in ("article", "main") else int(self.tags[i] == "h1")
            room[p] = max(room[p], room[i], holds)
        inside = [False] * n
        for i in range(1, n):
            p = self.parents[i]
            inside[i] = inside[p] or self.tags[i] in ("article", "main")
            if self.weak[i] > room[i] and not (self.tags[i] == "header" and inside[i]):
                self.dropped[i] = True
            if self.tags[i] in ("ul", "ol") and links[i] >= 3 and total[i] == total_linked[i]:
                self.dropped[i] = True  # a menu
            self.dropped[i] = self.dropped[i] or self.dropped[p]
        self.linked = linked

    def best(self) -> tuple[int, float]:
        """The container that holds the most text of its own, and its score."""
        n = len(self.tags)
        home, score = [0] * n, [0.0] * n
        for i in range(1, n):
            home[i] = i if self.tags[i] in _CONTAINERS else home[self.parents[i]]
        for node, text in self.runs:
            if text and not self.dropped[node]:
                size = sum(map(len, text.split()))
                at = home[node]
                score[at] += -0.5 * size if self.linked[node] else size
                if at:
                    score[home[self.parents[at]]] += 0 if self.linked[node] else size / 2
        best = max(range(n), key=lambda i: (score[i], -i))
        most, around = score[best], best
        while around > 0 and self.tags[around] not in ("article", "main"):
            around = self.parents[around]
        if around > 0:  # parts of one article belong together
            return around, most
        while True:
            up = home[self.parents[best]] if best else 0
            if not up or self.tags[up] == "body" or score[up] < 0.75 * score[best]:
                return best, most
            best = up

    def path(self, node: int) -> list[str]:
        steps = []
        while node > 0:
            steps.append(self.steps[node])
            node = self.parents[node]
        return steps[::-1]

    def at_paths(self, paths: list[list[str]]) -> list[list[int]]:
        """For each path, the elements at it that are not left out, none inside another."""
        trie: dict = {}
        for k, steps in enumerate(paths):
            here = trie
            for step in steps:
                here = here.setdefault(step, {})
            here.setdefault(None, []).append(k)
        found: list[list[int]] = [[] for _ in paths]
        state: list = [trie]
        for k in trie.get(None, ()):
            found[k].append(0)
        for i in range(1, len(self.tags)):
            up = state[self.parents[i]]
            here = up.get(self.steps[i]) if up and not self.dropped[i] else None
            state.append(here)
            for k in here.get(None, ()) if here else ():
                found[k].append(i)
        return found

    def text(self, nodes: list[int]) -> str:
        """The blocks of these elements in page order, one to a line."""
        kept = bytearray(len(self.tags))
        for i in nodes:
            kept[i : self.ends[i]] = b"\1" * (self.ends[i] - i)
        blocks: list[str] = []
        held: list[str] = []

        def flush() -> None:
            block = " ".join("".join(held).split())
            held.clear()
            if block:
                blocks.append(block)

        for node, text in self.runs:
            if text is None:
                flush()
            elif kept[node] and not self.dropped[node]:
                held.append(html.unescape(text) if "&" in text else text)
        flush()
        return "\n".join(blocks)


def main_text(page: Page, paths: list[list[str]]) -> str:
    """The text at the first of the paths that has any on this page, else in its best container."""
    for nodes in page.at_paths(paths):
        text = page.text(nodes) if nodes else ""
        if text:
            return text
    best, score = page.best()
    return page.text([best]) if score > 0 else ""


def votes(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``host, path, score``: each page's vote for the path of its best container."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, scores = [], []
            for source in batch.column("html").to_pylist():
                page = Page(source)
                best, score = page.best()
                paths.append(page.path(best) if score > 0 else None)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array(paths, pa.list_(pa.string())), pa.array(scores, pa.float64())], ["host", "path", "score"]
            )

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return rows.mapInArrow(vote, "host string, path array<string>, score double").where("path is not null")


def winning_paths(cast: DataFrame, least_share: float = 0.1) -> DataFrame:
    """``host, paths``: the paths with at least ``least_share`` of a host's votes, best first.

    Votes are counted by host and path before anything is gathered by host, and at most
    1 / ``least_share`` paths of a host win.
    """
    counted = cast.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score")).alias("score"))
    counted = stored(counted, "votes")
    hosts = counted.groupBy(F.col("host").alias("_host")).agg(F.sum("n").alias("_all"))
    won = counted.join(hosts, F.col("host") == F.col("_host")).where(F.col("n") >= F.col("_all") * least_share)
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("score"), "path")))
    return stored(won.groupBy("host").agg(F.transform(order, lambda s: s["path"]).alias("paths")), "winners")


_SALTS = 16


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_share: float = 0.1
) -> DataFrame:
    """``page_id, url, text`` for each row of ``pages``.

    Null and empty pages, and pages without an article, have an empty text. Pages without
    a host vote together. Rows that repeat an id are extracted one by one; an empty table
    gives an empty one. A host may hold any share of the pages: its winners, a handful of
    paths, are dealt out in salted copies where Spark does not broadcast them for their size.
    """
    winners = winning_paths(votes(pages, html_col, url_col), least_share)
    dealt = winners.select(F.col("host").alias("_host"), "paths", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt"))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        host_of(F.col(url_col)).alias("_at"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(url_col)), F.lit(_SALTS)).cast("int").alias("_own"),
    )
    joined = rows.join(dealt, (F.col("_at") == F.col("_host")) & (F.col("_own") == F.col("_salt")), "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, paths = batch.column("html").to_pylist(), batch.column("paths").to_pylist()
            texts = [main_text(Page(s), p or []) for s, p in zip(sources, paths, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    return joined.select("page_id", "url", "html", "paths").mapInArrow(read, "page_id long, url string, text string")
