from html.parser import HTMLParser

import pytest

from engramix.llm import html_text
from engramix.llm.html_text import render

CASES = [
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<p>one<p>two <b>bold</b>  word", "one\n\ntwo bold word"),
    ("<h1>T</h1>a<br>b<div>c</div>d", "T\n\na\nb\nc\nd"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>x<li value=9>y<li>z</ol>", "3. x\n9. y\n10. z"),
    ("<ol type=a reversed><li>x<li>y</ol><ol type=I><li>q</ol>", "b. x\na. y\n\nI. q"),
    ("<ul><li><p>a</p><p>b</p></ul>", "- a\n\n  b"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td align=right>5<tr><td>x<td align=right>1234</table>", "Name       N\nlong name     5\nx          1234"),
    ("<table><td colspan=2>wide head cell<tr><td>a<td>b</table>", "wide head cell\na  b"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<table><tr><td><table><tr><td>i<td>j</table><td>k</table>after", "i  j  k\n\nafter"),
    ("<table><caption>Cap</caption><tr><td>x</table>", "Cap\nx"),
    ("<table><tr><td>日本<td>x<tr><td>abcd<td>y</table>", "日本  x\nabcd  y"),
    ("a<span hidden>no</span><i style='display: none'>no</i><b style='color:red'>yes</b>", "ayes"),
    ("<div style='visibility:hidden'>no<p style='visibility: visible'>yes</div>", "yes"),
    ("<style>.ad, #x{display:none} p > a{display:none}</style><div class='big ad'>no</div><p id=x>no<p>yes <a>link</a>", "yes link"),
    ("<head><title>t</title></head><script>if (a</b) '<p>'</script><!-- <p>no --><p>yes", "yes"),
    ("<details><summary>s</summary>hidden</details><details open><summary>s</summary>shown</details><dialog>no</dialog>", "s\ns\nshown"),
    ("<pre>\n a  b\n  c</pre>x", "a  b\n  c\n\nx".replace("a", " a", 1)),
    ("<select><option>a<option selected>b</select> <input type=hidden value=no><input type=submit value=Go>", "b Go"),
    ("&lt;x&gt; &amp;amp; &copy &eacute;&nbsp;y", "<x> &amp; © é y"),
    ("<dl><dt>t<dd>d1<dd>d2<dt>u</dl>", "t\n    d1\n    d2\nu"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("a < b and 1<2 <3", "a < b and 1<2 <3"),
    ("x<p", "x"),
    ("a</p>b</br>c</nope>d", "a\n\nb\ncd"),
    ("<q>hi</q><select></select>", "“hi”"),
    ("<b><p>x</b>y</p>z", "xy\n\nz"),
    ("</table><td>a</td>", "a"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_cases(html, text):
    assert render(html) == text


def test_deep_and_long():
    assert render("<div>" * 20_000 + "x") == "x"
    assert render("<table><tr><td>" * 300 + "x").strip() == "x"
    assert render("<ul><li>" * 500 + "x").endswith("- x")
    assert len(render("word " * 200_000).split()) == 200_000
    assert render('<a href="' + "x" * 100_000) == ""


class Plain(HTMLParser):
    """Brute force for the words alone: all text outside head, script and style."""

    def __init__(self):
        super().__init__()
        self.skip, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("head", "script", "style")
        self.words.append("\n" if tag in html_text._BLOCK or tag == "br" else "")

    def handle_endtag(self, tag):
        self.skip -= tag in ("head", "script", "style")
        self.words.append("\n" if tag in html_text._BLOCK else "")

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)


def test_all_words_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert len(found) == 50
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        assert [w for w in found[r.page_id].split() if w != "-"] == [w for w in "".join(plain.words).split() if w != "-"]


def test_table_edges(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x", "t"), (1, "u", "<p>x", "t"), (2, None, None, "t"), (None, "v", "", None)], "page_id long, url string, html string, text string")
    rows = html_text.extract(pages).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text if r.text is not None else "NULL") for r in rows) == [(0, "v", ""), (1, "u", "x"), (1, "u", "x"), (2, "", "NULL")]
    assert html_text.extract(pages.limit(0)).collect() == []


def test_carried_columns_keep_their_names(spark):
    pages = spark.createDataFrame([(1, "<p>a", "own")], "page_id long, html string, text string")
    assert html_text.extract(pages, carry=("page_id", "text", "html")).collect() == [(1, "own", "<p>a", "a")]
