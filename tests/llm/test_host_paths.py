"""Main text of pages: hand-made pages, hosts that vote, and the whole table against patterns."""

import html
import re

import pytest

from leafwork.llm import host_paths
from leafwork.llm.host_paths import Page, main_text
from leafwork.llm.registry import LLM

SCHEMA = "page_id long, url string, html string, host string, paths int, _salt int, _own int, text string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", 1, 2, 3, "t") for i, u, h in rows], SCHEMA)


LONG = "words of the article that go on for a while, with commas, and end."
CASES = [
    ("plain text only", "plain text only"),
    ("<p>one<p>two", "one\ntwo"),
    (f"<nav>menu</nav><div class=content><h1>T</h1><p>{LONG}</p><div class='share-bar'>share</div><p>more</p></div>", f"T\n{LONG}\nmore"),
    (f"<article>{LONG}</article><div id=comments><article class=comment>{LONG * 3}</article></div>", LONG),
    ("<article><header><h1>Title</h1></header><section><p>x y z</p></section><section>aa</section></article><header><h1>Site</h1></header>", "Title\nx y z\naa"),
    ("<article>x<ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><ul><li>y <a>z</a></li></ul><aside>no</aside></article>", "x\ny z"),
    ("<p>a &lt b &amp;lt; &nbsp; c &#x41;&eacute;</p><!-- x", "a < b &lt; c Aé"),
    ("<article>x<script>if(a<b)</article></script>y<style>p{}</style>z</article>", "xyz"),
    ("<article><p><b>open <i>tags<br>here<p>next</article> after", "open tags here\nnext"),
    ("<article>a<form><p>f</p></form>b<div class=advert>ad</div><div class=adverbial>adverb</div></article>", "a\nb\nadverb"),
    (f"<body class=has-sidebar><div class='page no-sidebar'><div class=sidebar>s s s</div><div class=post-12><p>{LONG}</p></div></div>", LONG),
    ('<article title="a > b">x < y <3 </ z></article>', "x < y <3"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"),
    ("<article>kept <a href='cut", "kept"),
    ("", ""), ("<nav>menu</nav>", ""), ("<article></article>", ""), ("<html><body><footer>f</footer>", ""),
]


@pytest.mark.parametrize("page, text", CASES)
def test_page(page, text):
    assert main_text(Page(page), []) == text


def test_odd_markup_takes_linear_time():
    for page in ('<a ">' * 50_000, '<a x=">' * 50_001, "<a " * 50_000, "<" * 50_000, "<!--" * 50_000, "<div>" * 20_000 + "x", "<p " + '"' * 50_001 + ">y"):
        main_text(Page(page), [["html", "a"]])


def test_pages_follow_the_path_of_their_host(spark):
    noise = "<div class=box-{k}><p>Some other text of this page that is longer than the article is.</p></div>"
    page = "<body><div class='story s{k}'><p>{t}</p></div>{n}"
    rows = [(k, "http://A.example:80/x", page.format(k=k, t=f"A long story, number {k}, that takes more room than the box below it does, by far.", n=noise.format(k=k))) for k in range(9)]
    rows.append((50, "https://a.example/y", page.format(k=7, t="Short one.", n=noise.format(k=1))))
    rows.append((51, "https://b.example/y", page.format(k=7, t="Short one.", n=noise.format(k=1))))
    got = {r["page_id"]: r["text"] for r in host_paths.extract(frame(spark, rows)).collect()}
    assert got[50] == "Short one." and got[51].startswith("Some other text")
    assert all(got[k].startswith("A long story") and "\n" not in got[k] for k in range(9))


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "http://a.b/c", None), (1, "http://a.b/c", "<article>x</article>"), (1, "http://a.b/c", "<article>x</article>"), (2, "no address", "<p>hi"), (3, None, "")]
    got = sorted((r["page_id"] or 0, r["url"] or "", r["text"]) for r in host_paths.extract(frame(spark, rows)).collect())
    assert got == sorted((i or 0, u or "", main_text(Page(h or ""), [])) for i, u, h in rows)
    empty = host_paths.extract(frame(spark, []))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text"]


def test_registered_query_equals_patterns(spark):
    folder = "/root/testdata/sf0.01"

    def plain(source):
        found = re.search("<article>(.*?)</article>", source, re.S)
        blocks = re.split("</?(?:p|h1)>", found[1]) if found else []
        texts = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks)
        return "\n".join(t for t in texts if t)

    pages = {r["page_id"]: (r["url"], plain(r["html"])) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = LLM["op12_html_text"][0](spark, folder).collect()
    assert {r["page_id"]: (r["url"], r["text"]) for r in rows} == pages and len(rows) == len(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
