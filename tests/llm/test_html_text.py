"""Operator 9: layouts worked out by hand, and order of all words on random trees."""
import random
import time

import pytest

from proflex.llm.html_text import MAX_INDENT, extract, extract_pages

CASES = [
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<title>t</title><body>x<script>y</script><style>z</style>", "x"),
    ("<p>a<br>b <b>c</b>d</p>", "a\nb cd"),
    ("<p>x<b>y<br><p>z</b> w</p>", "xy\n\nz w"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "- a\n- b\n  - c\n- d\n\ne"),
    ("<ol start=3><li>a</li><li>b</li></ol>", "3. a\n4. b"),
    ("<p hidden>a</p><p style='color:red; display: none'>b</p><p>c</p>", "c"),
    ("<table><tr><th>k<th>value<tr><td>long<td>1</table>", "k     value\nlong  1"),
    ("<table><td>a<td>b<tr><td colspan=2>c<td>d</table>z", "a  b\nc     d\n\nz"),
    ("<table><tr><td>a<table><tr><td>x<td>y</table><td>b</table>", "a x  y  b"),
    ("<pre>a\n  b\n\nc</pre>d", "a\n  b\n\nc\n\nd"),
    ("<blockquote>q</blockquote>r", "  q\n\nr"),
    ("a&amp;b &copy; &#65;", "a&b © A"),
    ("<p>a</i></div>b</p></p>c", "ab\n\nc"),
    ("<img alt='pic'><input value=v><input type=hidden value=h>", "picv"),
    ("<li>a<li>b", "- a\n- b"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<!-- c --><!DOCTYPE html><html lang=x><head><meta charset=u></head><body>k", "k"),
    ("<a>x<a>y", "xy"),
    ("<td>alone", "alone"),
    ("a < b <", "a < b <"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_layout(html, text):
    assert extract(html) == text


def test_all_words_in_order():
    rng = random.Random(9)
    count = 0

    def tree(depth):
        nonlocal count
        parts = []
        for _ in range(rng.randint(1, 4)):
            if depth == 0 or rng.random() < 0.4:
                count += 1
                parts.append(f" w{count} ")
            else:
                tag = rng.choice(["div", "b", "ul", "li", "blockquote", "span", "section", "h2", "table", "pre"])
                inner = tree(depth - 1)
                if tag == "table":
                    inner = f"<tr><td>{inner}</td></tr>"
                elif tag == "ul":
                    inner = f"<li>{inner}</li>"
                parts.append(f"<{tag}>{inner}</{tag}>")
        return "".join(parts)

    for _ in range(200):
        count = 0
        words = [w for w in extract(tree(5)).replace("- ", " ").split()]
        assert words == [f"w{i + 1}" for i in range(count)]


def test_deep_and_long():
    assert extract("<div>" * 20000 + "x") == "x"
    assert extract("<p>" + "word " * 200000).count("word") == 200000


def test_table_cases(spark):
    df = spark.createDataFrame([(1, None, "u", 1), (2, "", "u", 2), (3, "<p>a", "u", 3), (3, "<p>a", "u", 3)],
                               "page_id long, html string, text string, doc_id int")
    got = sorted((r.page_id, r.text, r.n_lines) for r in extract_pages(df).collect())
    assert got == [(1, "", 0), (2, "", 0), (3, "a", 1), (3, "a", 1)]
    assert extract_pages(df.limit(0)).count() == 0


SHOWN = [
    ("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> then", "if x=1 then"),
    ("a<svg><title>t</title><defs><text>d</text></defs><path d='M0'/><text>q<tspan>r</tspan></text><text>s</text></svg>b", "a\nqr\ns\nb"),
    ("<svg>x<g>y</g></svg>z", "z"),
    ("note <textarea rows=2>\nfirst <b>\nsecond</textarea><p>z", "note first <b>\nsecond\n\nz"),
    ("size <select><option>S<option selected>M<option>L</select> now", "size M now"),
    ("<select><option disabled>choose<option>one<option>two</select>", "one"),
    ("<select><option selected hidden>choose<option>one</select>", "choose"),
    ("<select><optgroup label=g disabled><option>a</optgroup><option label=B>b</select>", "B"),
    ("x<select multiple><optgroup label=g><option>a<option>b</select>y", "x\ng\na\nb\ny"),
    ("<li>i <select><option>a<option>b</select><li>k", "- i a\n- k"),
    ("<li><select><option>a</select><li>k", "- a\n- k"),
    ("<table><tr><td><select><option>a<option>b</select><td>c</table>", "a  c"),
    ("<select hidden><option>a</select><select><option>b<select><option>c", "bc"),
    ("<object data=f><param name=n>fallback</object>", "fallback"),
    ("<input type=email value=a@b.c> <input type=number value=7> <input type=url value=u> <input type=tel value=1>", "a@b.c 7 u 1"),
    ("<input type=password value=p><input type=checkbox value=c><input type=image alt=go>", "go"),
    ("<svg><text>a</text><p>b", "a\n\nb"),
    ("<svg><foreignObject><p>b</p></foreignObject></svg>c", "b\n\nc"),
    ("<audio>no audio</audio><video>no video</video>x", "x"),
]


@pytest.mark.parametrize("html,text", SHOWN)
def test_shown_elements(html, text):
    assert extract(html) == text


MORE = [
    ("<details><summary>s</summary>inner<p>x</details>y", "s\ny"),
    ("<details open><summary>s</summary>inner</details>y", "s\ninner\ny"),
    ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>d", "b\nd"),
    ("<div style='display:none'>a<b style='visibility:visible'>b</b></div>d", "d"),
    ("<ol type=a start=26><li>x<li>y</ol>", "z. x\naa. y"),
    ("<ol type=I><li>x<li value=9>y<li>z</ol>", "I. x\nIX. y\nX. z"),
    ("<ol reversed><li>x<li>y<li>z</ol>", "3. x\n2. y\n1. z"),
    ("<ol reversed start=9><li>x<li>y</ol>", "9. x\n8. y"),
    ("say <q>a <q>b</q></q>", "say “a ‘b’”"),
    ("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  b  c\n   d  e\nf  g"),
    ("<table><tr><td colspan=500>title over all<tr><td>a<td>b</table>", "title over all\na  b"),
    ("x<!-- a > b -- c -->y<!-->z<!--->w<!-- open", "xyzw"),
    ("x</>y</ z>w<?p q>v</", "xywv</"),
    ("x<a href='>'>y</a><b title=\"<i>\">z</b>", "xyz"),
    ("<p class=a class=b hidden=x>h</p><textarea>&lt;b></i></textarea>", "<b></i>"),
    ("<script>if (a</b) '</scripts>'</script>x<style>", "x"),
    ("x <b unfinished='", "x"),
    ("<div/>a<svg><text>b</text><path/></svg>c", "a\nb\nc"),
    ("<svg><text><![CDATA[a<b]]></text></svg><![CDATA[c]]>", "a<b"),
]


@pytest.mark.parametrize("html,text", MORE)
def test_more_layouts(html, text):
    assert extract(html) == text


@pytest.mark.parametrize("html", ["<a " * 100000, "<!--" * 100000, "</a " * 100000, "<!" * 100000, "<a b='" * 100000, "<script>" * 50000,
                                  "<textarea>" * 50000, "</" * 100000, "&" * 300000, "<p><button>" + "<div>" * 50000,
                                  "<select>" + "<b>" * 50000 + "<option>" * 20000, "<a b" + " " * 300000 + "c>"])
def test_linear_time(html):
    start = time.process_time()
    extract(html)
    assert time.process_time() - start < 5


def test_nested_lists_are_bounded():
    html = "<ul><li>x" * 4000
    text = extract(html)
    assert text.count("x") == 4000 and len(text) < 4000 * (MAX_INDENT + 4)
