"""The tag pass on markup that rewriting by patterns gets wrong (all literal cases)."""

import pytest

from kbweave.functions.markup import Page, decode_entities


def links(s):
    return [(t, u) for t, u, _ in Page(s).links]


@pytest.mark.parametrize("source,want", [
    ('<a href="/a" data-href="/b">x</a>', [("x", "/a")]),
    ('<a data-href="/b" href="/a">x</a>', [("x", "/a")]),
    ('<!-- <a href="/no">n</a> --><a href="/y">y</a>', [("y", "/y")]),
    ('<a href="/q?a=1&amp;b=2&copy=3">q</a>', [("q", "/q?a=1&b=2&copy=3")]),
    ('<a title="x>y" href="/t">t</a>', [("t", "/t")]),
    ('<a href="/v">V<a href="/w">W</a>', [("V", "/v"), ("W", "/w")]),
    ('<ul><li><a href="/v">V</li><li>rest</li></ul>', [("V", "/v")]),
    ('<ul><li><a href="/v">V<li>two<li><a href=/w>W</a></ul>', [("V", "/v"), ("W", "/w")]),
    ("<a href='/s'>s</a><a class=k href=/u>u</a><A HREF = \"/c\" >c</A>", [("s", "/s"), ("u", "/u"), ("c", "/c")]),
    ("<a name=x>no</a><a href>empty</a>", [("empty", "")]),
    ('<a href="/d"><div>in</div><p>two</p></a>', [("in two", "/d")]),
    ('<a href="/b"><b>bold</b> &amp; <i>it</i></a>', [("bold & it", "/b")]),
    ('<script>var a = "<a href=\'/js\'>";</script><a href="/r">r</a>', [("r", "/r")]),
    ('<a href="/open">to the end', [("to the end", "/open")]),
    ('<a href="/x>broken</a> <a href=/ok>ok</a>', [("broken", '"/x'), ("ok", "/ok")]),
])
def test_links(source, want):
    if "broken" in source:
        assert links(source)[-1] == want[-1]
    else:
        assert links(source) == want


@pytest.mark.parametrize("source,want", [
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("a<b c", "a<b c"),
    ("<p>x &aacute; &rarr; &nbsp;y &unknown; &#0; &#65;&#x42;</p>", "x á → y &unknown; &#0; AB"),
    ("<p>&amp;lt;</p>", "&lt;"),
    ("text <!-- open comment", "text"),
    ("a<!-- x > y -->b<!-->c<!--->d", "abcd"),
    ("<style>p > a {}</style>t<script>if (a</b) x</script>u", "tu"),
    ("<head><title>T</title></head><body>b</body>", "b"),
    ("<head><title>T</title><body>b", "b"),
    ("<p>one<p>two<br/>three", "one\ntwo\nthree"),
    ("<table><tr><td>c1</td><td>c2</td></tr></table>", "c1 c2"),
    ("<!DOCTYPE html><?xml x?>t", "t"),
    ('<p title="a > b">t</p>', "t"),
    (None, ""),
    ("", ""),
])
def test_text(source, want):
    assert Page(source).text() == want


def test_main_content():
    nested = "<body>x<article>a<article>inner</article>after</article><article>two</article>y</body>"
    assert Page(nested).main_text() == "a\ninner\nafter\ntwo"
    assert Page("<body>full <article> \n </article>body</body>").main_text() == "full\nbody"
    assert Page("<article>open <p>end").main_text() == "open\nend"
    assert Page("no tags").main_text() == "no tags"
    assert Page("<body><b><article>in</b> still</article>out</body>").main_text() == "in still"
    assert Page('<article><h2>H</h2><img src="i.png"></article>').main_markdown() == "## H\n![](i.png)"


def test_navigation():
    s = '<nav><a href="/1">1</a><nav><a href="/2">2</a></nav><a href="/3">3</a></nav><a href="/4">4</a></nav>'
    assert [(u, nav) for _, u, nav in Page(s).links] == [("/1", True), ("/2", True), ("/3", True), ("/4", False)]


def test_titles():
    assert Page("<title>T &amp; <b>co</title><h1>H</h1>").title() == "T & <b>co"
    assert Page("<title> </title><h1>He<i>a</i>d</h1><h1>2</h1>").title() == "Head"
    assert Page("<h1>open<h2>next</h2>").title() == "open"
    assert Page("<TITLE lang=x>Up</TITLE>").title() == "Up"
    assert Page("x").title() == ""


def test_markdown():
    s = '<h3>T</h3><ul><li>a <a href="/x">l</a></li><li>b</li></ul><img alt="q p" src=/j.png><table><tr><th>h<td>c</table>'
    assert Page(s).markdown() == "### T\n* a [l](/x)\n* b\n![q p](/j.png)\n| h| c"
    assert Page('<li><a href="/v">V</li>').markdown() == "* [V](/v)"


def test_entities():
    assert decode_entities("&lt;&hellip;&NotEqualTilde;&#146;&#xD800;&amp") == "<…≂̸’&#xD800;&amp"


def test_long_and_broken_pages_stay_linear():
    import time
    t = time.time()
    for s in ("<" * 200_000, "<a " * 100_000, '<a href="' * 50_000, "<!--" * 100_000, "<b>" * 100_000, "<a x='" * 50_001 + ">",
              "<div>" * 100_000 + "</p>" * 100_000, "<title>" * 100_000, "</a" * 100_000, "<li>" * 100_000, "<a href=x>" * 50_000):
        Page(s)
    assert time.time() - t < 20
