"""Markdown blocks and HTML strings: the block rules of CommonMark, malformed input, long input."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import markup, normalise

MARKDOWN = [
    ("# Foo\n## Bar ##\n#5 bolt\n#\n", "Foo\nBar\n#5 bolt"), ("Foo\n===\nBar\nbaz\n---\n", "Foo\nBar\nbaz"), ("one\nline two\n\n    code\n\nnext", "one\nline two\nnext"), ("\\# no heading", "\\# no heading"),
    ("> quote\nlazy\n> - item\n>   more\n> text\n\nafter", "quote\nlazy\nitem\nmore\ntext\nafter"), ("- a\n- b\n  - c\n\n  in b\n1. one\n2. two", "a\nb\nc\nin b\none\ntwo"), ("text\n14. no list", "text\n14. no list"),
    ("text\n- item\n14. new list", "text\nitem\nnew list"), ("***\n---\n___\n- - -\nx", "x"), ("<div>\nraw *x*\n</div>\n\n*kept* [a](b)", "*kept* [a](b)"), ("<!-- c\n\nd --> x\ny", "y"), ("a <b>c</b> `d`", "a <b>c</b> `d`"),
    ("<b>\nx\n\ny", "y"), ("p\n<b>\nx", "p\n<b>\nx"), ('[foo]: /url "title"\n\n[foo]', "[foo]"), ("[foo]: /url\ntext", "text"), ("[foo]: /url 'a\nb'\n[bar]: <x>", ""), ("[]: /url", "[]: /url"), ("~~~\ncode\n~~~\nx", "x"),
    ("~~~\nnever closed", ""), ("-\n\n  foo", "foo"), ("- foo\n\n      code\n- bar", "foo\nbar"), ("-     code\n\n  para", "para"), ("1)\tx\n\ty", "x\ny"), (">> a\n> b\nc", "a\nb\nc"), ("> ~~~\n> x\n> ~~~\ny", "y"),
    ("    code first\ntext", "text"), ("| a | b |\n| - | - |", "| a | b |\n| - | - |"), ("Foo\n    bar", "Foo\n    bar"), ("* a\n\n\n\n* b", "a\nb"), ("===", "==="), ("> foo\n---", "foo"), ("> foo\n===", "foo\n==="), ("Foo\n-", "Foo"),
    ("<script>\nx\n\ny</script>\nz", "z"), ("- a\r\n- b\r", "a\nb"), ("", ""), (None, None),
]
HTML = [
    ("<!DOCTYPE html><title>T</title><p>a <code>b</code>c<pre>no<b>x</b></pre> &amp; &eacute;&#x41; c</p>", "T a b c & éA c"), ("<script>if (a<b) x</script><style>p{}</style>y", "y"), ("<nav><ul><li>q</ul></nav>1 < 2 <!-- z -->end<br/>x", "1 < 2 end x"),
    ("<div title='a>b'>c</div>", "c"), ("<nav>never closed", ""), ("a</nav>b", "a b"), ("<p> \n one\n two </p>", "one\n two"), ("&lt;b&gt; &nbsp;x&copy", "<b> \xa0x©"), ("<![CDATA[x]]>y", "y"), ("", ""), (None, None),
]


def test_markdown_blocks(spark):
    for text, want in MARKDOWN:
        assert markup.markdown_blocks(text) == want, text
    df = spark.createDataFrame(list(enumerate(t for t, _ in MARKDOWN)), "i int, t string")
    got = df.select("i", normalise.markdown_to_text(F.col("t")).alias("m")).orderBy("i").collect()
    assert [r["m"] for r in got] == [w for _, w in MARKDOWN]
    front = "---\ntitle: x\n---\n# Head\n\n```\ncode\n```\n- item `x`\n"
    assert spark.createDataFrame([(front,)], "t string").select(normalise.markdown_to_text(F.col("t")).alias("m")).first()["m"] == "Head\nitem `x`"


def test_containers_have_no_depth_limit():
    for deep in (60, 61, 1000):
        assert markup.markdown_blocks("> " * deep + "- item") == "item"
        lines = "> " * deep + "a\n" + "> " * deep + "b\n" + "> " * (deep - 1) + "lazy\n" + "\n" + "> " * 3 + "+ c"
        assert markup.markdown_blocks(lines) == "a\nb\nlazy\nc"
    assert markup.markdown_blocks("\n".join("  " * i + f"- x{i}" for i in range(1000))) == "\n".join(f"x{i}" for i in range(1000))


def test_html_strings(spark):
    for text, want in HTML:
        assert markup.html_strings(text) == want, text


def test_references_that_need_their_semicolon():
    for text, want in [("<p>a &amp;&amp</p> b", "a &&amp b"), ("a&quo</b>c &quot", "a&quo c &quot"), ("&ampx; &ltx &lt;", "&ampx; &ltx <"), ("&#39;&#x41;&copy;&nosuch;", "'A©&nosuch;"), ("a & b &; &1", "a & b &; &1"), ("<a t='&amp' u=&lt>x</a>", "x")]:
        assert markup.html_strings(text, bare=False) == want, text


def test_formats_by_suffix(spark):
    rows = [("a.MD", "# x"), ("b.html", "<p>x</p>"), ("c.rst", ".. note:: y\nx"), ("d.txt", "# x"), ("e", "<p>x</p>"), ("f.markdown", None)]
    got = spark.createDataFrame(rows, "p string, t string").select(normalise.to_text(F.col("p"), F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == ["x", "x", "x", "# x", "<p>x</p>", None]


@pytest.mark.parametrize("text", ["> a\nb\n" * 20_000, "- a\n" * 20_000 + "x\n" * 20_000, ("> " * 90 + "a\n") * 500, "> " * 500_000 + "x", "- " * 5000 + "x", "[a]: b\n" * 20_000, "[" * 50_000, "<" * 50_000, "`" * 50_000, "#" * 50_000, "- \n" * 20_000, "    x\n" * 20_000])
def test_long_input_takes_time_in_proportion(text):
    began = time.perf_counter()
    markup.markdown_blocks(text)
    markup.html_strings(text)
    assert time.perf_counter() - began < 5
