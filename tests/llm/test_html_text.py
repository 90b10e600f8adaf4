"""Operator 1: rendered layout of worked examples, and all visible words against a plain scan."""

import re
from html import unescape

import pytest

from spanwise.llm.html_text import rendered, visible_text

CASES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("  a \n <b> b</b>c  d ", "a bc d"),
    ("<h1>T</h1>x", "T\n\nx"),
    ("<ul><li>a<li>b<ol><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  1. x\n  2. y\n- c"),
    ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
    ("<table><tr><th>Name<th>Qty<tr><td>Apple<td>3<tr><td>Kiwi pie<td>12</table>", "Name      Qty\nApple     3\nKiwi pie  12"),
    ("<table><caption>C</caption><tbody><tr><td>a</td><td></td><td>c</td></tr><tr><td>bb</td><td>x</td><td>d</td></tr></tbody></table>", "C\na      c\nbb  x  d"),
    ("<pre>a\n  b\n\nc</pre>d", "a\n  b\n\nc\n\nd"),
    ("<p>1 &lt; 2 &amp; &eacute;</p>", "1 < 2 & é"),
    ("<head><title>no</title></head><body>yes<script>no</script><style>no</style><template>no</template></body>", "yes"),
    ("a<span hidden>no</span><span style='DISPLAY : none'>no</span><span style=\"visibility:hidden\">no</span>b", "ab"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<blockquote>q</blockquote>x", "  q\n\nx"),
    ("<!-- no -->a<!doctype html><?x no>b", "ab"),
    ("<p><b>a<p>b</b> c", "a\n\nb c"),
    ("<a title='x>y'>k</a>", "k"),
    ("<textarea>a &amp; <b></textarea>", "a & <b>"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("a < b", "a < b"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("html, text", CASES)
def test_worked_examples(html, text):
    assert visible_text(html) == text


def test_odd_input_stays_linear_and_whole():
    deep = visible_text("<div>" * 5000 + "x" + "</div>" * 5000 + "y")
    assert deep.split() == ["x", "y"]
    for s in ("<a \"" * 20000, "<" * 50000, "<!--" * 20000, "<a ='" * 20000, "</p>" * 20000, "<script>" * 5000, "&" * 50000):
        visible_text(s)
    assert visible_text("x" * 300_000 + "<p>" + "y" * 300_000).count("y") == 300_000


def plain_words(html):
    """Words outside tags, scripts, styles and the head."""
    body = re.sub(r"(?s)<head>.*?</head>|<script>.*?</script>|<style>.*?</style>|<!--.*?-->", " ", html)
    body = re.sub(r"<br>|</?(?:p|li|ul|div|h1|nav|article|footer|body|html)\b[^>]*>|<!DOCTYPE[^>]*>", " ", body)
    return unescape(re.sub(r"<[^>]*>", "", body)).split()


def test_all_visible_words_of_whole_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in rendered(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        items = len(re.findall("<li>", r.html))
        words = got[r.page_id].split()
        assert words.count("-") >= items
        assert [w for w in words if w != "-"] == [w for w in plain_words(r.html) if w != "-"]


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(1, "<p>a", "x"), (1, "<p>a", "x"), (None, "b", "y"), (2, None, None), (3, "", "z")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted(((r.page_id, r.text) for r in rendered(df).collect()), key=str)
    assert got == sorted([(1, "a"), (1, "a"), (None, "b"), (2, ""), (3, "")], key=str)
    assert rendered(df.limit(0)).count() == 0


MORE_CASES = [
    ("<head><title>t</title><p>whole article", "whole article"),
    ("<!DOCTYPE html><html><head>\n<meta charset=utf-8><title>t</title>\n<style>s</style>\nplain <b>text</b>", "plain text"),
    ("<head><script>no</script><noscript>no</noscript><template><p>no</template><link href=x><h1>T</h1>x", "T\n\nx"),
    ("<head><title>t</title></head><p>a<head><p>b", "a\n\nb"),
    ("<p>a<head><p>b", "a\n\nb"),
    ("<html><head></html>late", "late"),
    ("a<svg><title>no</title><desc>no</desc><defs><text>no</text></defs> no <g><text>North <tspan>Sea</tspan></text></g><text>12 km</text></svg>b", "a North Sea 12 km b"),
    ("<svg><foreignObject><p>x</p></foreignObject><path d=x /></svg>", "x"),
    ("<math><mi>x</mi><mo>=</mo><semantics><mn>2</mn><annotation>no</annotation><annotation-xml>no</annotation-xml></semantics></math>", "x=2"),
    ("<object data=x><param name=a value=no><p>fallback</object>", "fallback"),
]


@pytest.mark.parametrize("html, text", MORE_CASES)
def test_implied_end_of_head_and_embedded_text(html, text):
    assert visible_text(html) == text
