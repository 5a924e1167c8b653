"""Layout of small pages written out by hand, and pages of every odd kind."""

import time

import pytest

from vulnloom.llm.html_layout import extract, rendered

PAGES = {
    "implied paragraphs": ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
    "white space": (" a\n <b> b</b>c  <i>d </i> e&nbsp;&nbsp;f", "a bc d e  f"),
    "line breaks": ("a<br>b<br><br>c", "a\nb\n\nc"),
    "lists": ("<ul><li>x<li>y<ol start=3><li>q<li>r</ol><li>z</ul>t", "- x\n- y\n  3. q\n  4. r\n- z\n\nt"),
    "paragraphs in items": ("<ul><li><p>a</p><p>b</p></li></ul>", "- a\n\n  b"),
    "table": ("<table><tr><td>aa<td>b<tr><td>c<td>dddd<br>e</table>after", "aa | b\nc  | dddd\n   | e\n\nafter"),
    "spans": (
        "<table><tr><th colspan=2>head<th>x</tr><tr><td rowspan=2>r<td>1<td>2<tr><td>3<td>4</table>",
        "head  | x\nr | 1 | 2\n  | 3 | 4",
    ),
    "nested table": ("<table><tr><td>a<td><table><tr><td>p<td>q</table></table>", "a | p | q"),
    "hidden": ("<p hidden>no</p><p style='DISPLAY : none !important'>no</p><p>yes</p><dialog>no</dialog><template>no</template>", "yes"),
    "visibility": ("<span style='visibility:hidden'>no <b style='visibility: visible'>yes</b></span>", "yes"),
    "head": ("<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body>x", "x"),
    "head without body": ("<meta charset=utf-8><title>t</title>text", "text"),
    "preformatted": ("a<pre>  x\n   y\n</pre>b", "a\n\n  x\n   y\n\nb"),
    "markup as text": ("3 < 4 &lt;b&gt; &amp;amp; <textarea><b></textarea>", "3 < 4 <b> &amp; <b>"),
    "comments": ("a<!-- <p>no</p> -->b<!doctype html><?pi?>c<!-- open", "abc"),
    "quotes": ("<a title='x>y' data-x=\"a'b>\">ok</a><p \"<b>x", "ok\n\nx"),
    "stray end tags": ("</div>a</p>b</table></td>c</br>d", "a\n\nbc\nd"),
    "misnested": ("<b>x<p>y</b>z", "x\n\nyz"),
    "definition list": ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\nb\nc\nd"),
    "cell without a table": ("<td>x</td>", "x"),
    "empty": ("", ""),
    "only white space": (" \n ", ""),
    "odd numbers": ("<ol start=x><li>a</ol><table><tr><td colspan=999999999 rowspan=-1>b</table>", "1. a\n\nb"),
}


@pytest.mark.parametrize("name", PAGES)
def test_layout(name):
    page, text = PAGES[name]
    assert rendered(page) == text


def test_bars_in_the_last_cell_stay():
    assert rendered("<table><tr><td>a<td>|<tr><td>or<td>||<tr><td>x<td>y |<tr><td>z<td></table>") == "a  | |\nor | ||\nx  | y |\nz"


def test_long_spans():
    rows = "".join(f"<tr><td>{i}" for i in range(150))
    lines = rendered(f"<table><tr><td rowspan=151>r<td>b{rows}</table>").split("\n")
    assert lines[1] == "  | 0" and lines[150] == "  | 149"
    below = "<tr>" + "<td>" * 149 + "<td>x<td>y"
    first, second = rendered(f"<table><tr><td colspan=150>a<td>b{below}</table>").split("\n")
    assert first.index("b") == second.index("y")


@pytest.mark.parametrize(
    "page",
    ["<div>" * 100_000 + "deep", "<p>" * 50_000 + "x", "<table><tr><td>" * 3_000 + "x", "<a b=\"" * 50_000, "<" * 100_000, "<!--" * 50_000, "&#x" * 50_000, "</b>" * 50_000]
    + ["<ul><li>" * 3_000 + "x", "x " * 500_000, "<table>" + "<tr><td>a<td>" + "b" * 500 + "</table>" * 3],
)
def test_odd_pages_end_soon(page):
    began = time.time()
    rendered(page)
    assert time.time() - began < 20


def test_wide_cells_do_not_pad_all_rows():
    page = "<table>" + "<tr><td>a<td>b" * 2000 + "<tr><td>" + "w " * 20_000 + "<td>c</table>"
    assert len(rendered(page)) < 200_000


def test_extract(spark):
    rows = [(1, "u", "<p>a<p>b", "clash"), (1, "u", "<p>a<p>b", ""), (2, None, None, None), (None, "", "é", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = sorted((r.page_id or 0, r.text, r.n_chars, r.n_lines) for r in extract(pages).collect())
    assert found == [(0, "é", 1, 1), (1, "a\n\nb", 4, 3), (1, "a\n\nb", 4, 3), (2, "", 0, 0)]
    assert extract(pages.limit(0)).collect() == []
