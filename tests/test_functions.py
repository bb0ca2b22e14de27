"""Column functions on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from leafwork.functions import images, paths, text


def values(spark, inputs, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, c string")
    rows = df.select("i", *[c.alias(f"r{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [r[1] if len(columns) == 1 else tuple(r[1:]) for r in rows]


@pytest.mark.parametrize("content, title, live, saved", [
    ("# Title\nContent", "Title", "Title", "Title"),
    ("Content", "<test.md>", None, ""),
    (None, "<test.md>", None, None),
    ("\n\n  \t# Foo \r\nrest\n# x", "Foo", "Foo", "Foo"),
    ("#\tX", "<test.md>", "X", ""),
    ("## X", "<test.md>", None, ""),
    ("#", "<test.md>", "test.md", ""),
    ("#  \n# later", "<test.md>", "test.md", ""),
    ("﻿# B ", "B", "B", "B"),
    ("", "<test.md>", None, None),
    (" \n \n", "<test.md>", None, None),
    ("#X\ny", "<test.md>", "X", ""),
])
def test_titles(spark, content, title, live, saved):
    c, file = F.col("c"), F.lit("dir/test.md")
    got = values(spark, [content], text.topic_title(c, file), text.live_title(c, file), text.saved_title(c))
    assert got == [(title, live, saved)]


def test_set_title(spark):
    cases = {
        "# Old Title\nContent": "# N $1\nContent",
        "Content": "# N $1\nContent",
        "\n \n\t# Old \r\nrest": "\n \n# N $1\nrest",
        "#\n# x": "# N $1\n#\n# x",
        "# only": "# N $1",
    }
    assert values(spark, list(cases), text.set_title(F.col("c"), F.lit("N $1"))) == list(cases.values())


def test_file_names(spark):
    c = F.col("c")
    got = values(spark, ["Mocked Topic Title", " A\tb  ", "a.md"], text.slug(c), text.start_page_file(c), text.numbered_file(c, F.lit(2)))
    assert got == [
        ("mocked-topic-title.md", "mocked-topic-title.md", "mocked-topic-title2.md"),
        ("a-b.md", "-a-b-.md", "-a-b-2.md"),
        ("a.md.md", "a.md.md", "a.md2.md"),
    ]


def test_instance_id_and_name(spark):
    assert values(spark, ["My  Documentation", " lead", ""], text.default_instance_id(F.col("c"))) == ["md", "l", ""]
    assert values(spark, ["n", "", None], text.instance_name(F.col("c"), F.lit("id"))) == ["n", "id", "id"]
    assert values(spark, [None], text.instance_name(F.col("c"), F.lit(""))) == ["Untitled"]


def test_posix_join(spark):
    srcs = ["./a.png", "../x.png", "/a.png", "a//b", "../../../q", "a/", "", "a/../b"]
    assert values(spark, srcs, paths.posix_join(F.lit(".."), F.lit("images"), F.col("c"))) == [
        "../images/a.png", "../x.png", "../images/a.png", "../images/a/b", "../../../q", "../images/a/", "../images", "../images/b",
    ]


def test_html_images(spark):
    cases = {
        '<img  src="a.png" x>': '<img src="../images/a.png" x>',
        '<IMG data-src="z" src="https://h">': '<IMG data-src="z" src="https://h">',
        "<img src='../images/a'/><img class=\"c\" src=\"./b.png\">": "<img src='../images/a'/><img class=\"c\" src=\"../images/b.png\">",
        '<img src="HTTPS://a"><img src="httpfoo.png"><img src="data:x">': '<img src="HTTPS://a"><img src="../images/httpfoo.png"><img src="../images/data:x">',
        "none": "none",
    }
    assert values(spark, list(cases), images.rewrite_html_images(F.col("c"), F.lit("images"))) == list(cases.values())


def test_markdown_images(spark):
    cases = {
        '![a](a.png) `![b](b.png)` ![c](<my file.png> "t")': '![a](../images/a.png) `![b](b.png)` ![c](<../images/my file.png> "t")',
        "x\n```\n![a](a.png)\n```\n![b](b.png)": "x\n```\n![a](a.png)\n```\n![b](../images/b.png)",
        "~~~js\n![z](z)": "~~~js\n![z](z)",
        "![a](http://x)![b](httpfoo.png)![c](data:i)![d](../images/x)": "![a](http://x)![b](httpfoo.png)![c](../images/data:i)![d](../images/x)",
        "``a ` ![x](x)`` ![y](y)": "``a ` ![x](x)`` ![y](../images/y)",
        "![open](": "![open](",
        "![a [b [c]] d](x.png)![a [b](y.png)![\\]](z.png)": "![a [b [c]] d](../images/x.png)![a [b](y.png)![\\]](../images/z.png)",
        "[![in](in.png)](out.png) ![p](a((1)b(2)).png)": "[![in](../images/in.png)](out.png) ![p](../images/a((1)b(2)).png)",
        "> ```\n> ![a](a.png)\n> ```\n> ![b](b.png)": "> ```\n> ![a](a.png)\n> ```\n> ![b](../images/b.png)",
        "> > ~~~\n> > ![a](a.png)\n\n![b](b.png)": "> > ~~~\n> > ![a](a.png)\n\n![b](../images/b.png)",
        "- ```js\n  ![a](a.png)\n\n  x\n  ```\n  ![b](b.png)": "- ```js\n  ![a](a.png)\n\n  x\n  ```\n  ![b](../images/b.png)",
        "12. ~~~\n    ![a](a.png)\nend ![b](b.png)": "12. ~~~\n    ![a](a.png)\nend ![b](../images/b.png)",
        "- ![a](a.png)\n> ![b](b.png)": "- ![a](../images/a.png)\n> ![b](../images/b.png)",
    }
    assert values(spark, list(cases), images.rewrite_markdown_images(F.col("c"), F.lit("images"))) == list(cases.values())


def test_deep_brackets_do_not_overflow(spark):
    texts = ["![" * 20_000, "![" + "[" * 50_000 + "](a.png)", "![a](" + "(" * 50_000, "> ```\n" + "> x\n" * 20_000, "![" + "[" * 12 + "]" * 12 + "](a.png)"]
    want = [*texts[:4], texts[4].replace("a.png", "../i/a.png")]
    assert values(spark, texts, images.rewrite_markdown_images(F.col("c"), F.lit("i"))) == want


def test_long_alt_text_does_not_overflow(spark):
    alt = "x" * 200_000
    assert values(spark, [f"![{alt}](a.png)"], images.rewrite_markdown_images(F.col("c"), F.lit("i"))) == [f"![{alt}](../i/a.png)"]
