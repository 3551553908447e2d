import re
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import html as h


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<div>one<div>two</div>three</div>", "one\ntwo\nthree"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
        ("<ol start=9><li>a<li>b<li value=3>c</ol>", "9. a\n10. b\n3. c"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3</table>", "Name   Qty\napple  3"),
        ("<table><td>a<td>b</table>", "a  b"),
        ("<table><tr><td colspan=2>wide one<td>x<tr><td>a<td>b<td>y</table>", "wide one  x\na  b      y"),
        ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
        ("x<span hidden>no</span><b style='display: none'>no</b>y", "xy"),
        ("<div style='visibility:hidden'>no<i style='visibility:visible'>yes</i></div>", "yes"),
        ("<head><title>no</title></head><script>if(a<b)'</p>'</script><style>p{}</style>yes", "yes"),
        ("<details><summary>s</summary>no</details><dialog>no</dialog>", "s"),
        ("<details open><summary>s</summary>yes</details>", "s\nyes"),
        ("<pre>\n a  b\n  c</pre>", " a  b\n  c"),
        ("a &amp; b &lt;i&gt; &#233; 3 < 4", "a & b <i> é 3 < 4"),
        ("<!-- no --><!doctype html><?x?>yes<!-- open", "yes"),
        ("a</b></p></table>b", "ab"),
        ("<a title='>'>x</a><a title='open", "x"),
        ("<blockquote>q</blockquote>r", "  q\n\nr"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<p>a<table><tr><td>b</table>c", "a\n\nb\n\nc"),
        ("<noscript>no</noscript><textarea>a <b></textarea>", "a <b>"),
    ],
)
def test_rendering(source, want):
    assert h.extract(source) == want or h.extract(source).strip("\n") == want.strip()


WORD = st.sampled_from(["alpha", "beta", "gamma"])
INLINE = st.sampled_from(["b", "i", "span", "a"])
BLOCK = st.sampled_from(["div", "p", "li", "td", "tr", "table", "ul", "section", "h1", "blockquote"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(WORD, BLOCK.map(lambda t: f"<{t}>"), BLOCK.map(lambda t: f"</{t}>"), INLINE.map(lambda t: f"<{t}>"), INLINE.map(lambda t: f"</{t}>")), max_size=60))
def test_no_visible_word_is_lost_or_made_up(parts):
    out = h.extract(" ".join(parts))
    want = [p for p in parts if p[0] != "<"]
    assert sorted(re.findall("[a-z]+", out)) == sorted(want)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/!-\"'= abdiptr&;\n", max_size=120))
def test_any_input_gives_text(source):
    assert isinstance(h.extract(source), str)


def test_deep_and_long_pages():
    assert h.extract("<div>" * 30000 + "x") == "x"
    assert h.extract("<table><tr><td>" * 2000 + "deep") == "deep"
    assert h.extract("<ul><li>" * 500 + "x").endswith("x")
    assert len(h.extract("<p>word</p>" * 20000).split()) == 20000
    wide = "<table><tr><td>" + "long " * 100 + "<td>" + "<br>".join(["b"] * 1000) + "</table>"
    assert len(h.extract(wide)) < 3 * len(wide)


@pytest.mark.parametrize("n", [1, 199, 200, 201, 5000])
def test_columns_stay_aligned_beside_a_wide_cell(n):
    lines = h.extract("<table>" + "".join(f"<tr><td>a{i}<td>b{i}<td>c{i}" for i in range(9)) + f"<tr><td>x<td>{'w' * n}<td>last</table>").split("\n")
    assert len(lines) == 10 and lines[-1].split() == ["x", "w" * n, "last"]
    assert len({line.index("b") for line in lines[:9]}) == 1 and len({line.index("c") for line in lines[:9]}) == 1
    assert lines[-1].index("w") == lines[0].index("b")


def test_spans_beyond_a_hundred_columns():
    lines = h.extract(f"<table><tr>{''.join(f'<td>c{i:03}' for i in range(150))}<tr><td colspan=149>wide<td>last</table>").split("\n")
    assert lines[1].index("last") == lines[0].index("c149")
    assert h.extract("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>").split("\n") == ["a  b", "   c", "   d"]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<button>Buy <b>now</b></button>", "Buy now"),
        ("<svg><title>no</title><defs><text>no</text></defs><text>Sales</text><g><text>2024</text></g></svg>", "Sales\n2024"),
        ("<form>Name <input value=Ann> <input type=submit value='Send it'><input type=hidden value=no><input type=password value=no></form>", "Name Ann Send it"),
        ("<input type=submit><input placeholder=Search><input type=checkbox value=no>", "Submit Search"),
        ("<object data=a.swf>Instead <p>of it</object>", "Instead\n\nof it"),
        ("<select><optgroup label=Fruit><option>Apple<option>Pear</select>", "Fruit\nApple\nPear"),
        ("<ruby>a<rp>(</rp><rt>b</rt><rp>)</rp></ruby>", "ab"),
    ],
)
def test_text_of_fields_graphics_and_fallbacks(source, want):
    assert h.extract(source).strip() == want


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = {r.page_id: r.text for r in h.pages_text(pages).collect()}
    source = {r.page_id: r.html for r in pages.collect()}
    assert rows.keys() == source.keys()
    for k, page in source.items():
        body = re.sub(r"(?is)<head.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->|<!doctype[^>]*>", "", page)
        assert "".join(unescape(re.sub(r"<[^>]*>", " ", body)).split()) == "".join(re.sub(r"(?m)^\s*- ", "", rows[k]).split())


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "<p>a", "x"), (None, "b", "x")], "page_id long, html string, text string")
    assert {(r.page_id, r.text, r.n_chars, r.n_lines) for r in h.pages_text(df).collect()} == {(1, "", 0, 0), (2, "", 0, 0), (2, "a", 1, 1), (None, "b", 1, 1)}
    assert h.pages_text(df.where("false")).count() == 0


@pytest.mark.parametrize(
    "source",
    [
        "<html><head><title>T</title><body><p>Hello",
        "<head><title>T</title><meta charset=utf-8><style>p{}</style><p>Hello",
        "<head> <script>x</script> \n Hello",
        "<head><head><title>T</title><div>Hello</div>",
        "<head><template><p>no</p></template><link rel=x><html><body>Hello",
        "<head><title>T</title></head><body><head>Hello",
    ],
)
def test_head_without_end_tag(source):
    assert h.render(h.parse(source)).strip() == "Hello"
