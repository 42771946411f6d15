"""Extraction, JSON cleaning/validation, entry expansion and atomicity."""

from pyspark.sql import functions as F

from kbweave.functions import html as H
from kbweave.functions import urls as U
from kbweave.functions.text import fingerprint, fmt2, py_strip
from kbweave.operators import entries as EN
from kbweave.operators import extract as X
from kbweave.operators import kb as K
from kbweave.schemas import ENTRY


def test_code_fences(spark):
    rows = [("```json\n{\"a\":1}\n```",), ("{\"a\":1}",), ("```\nx\n``` inner\ny\n```",),
            (" ```json\n{}\n```",)]
    df = spark.createDataFrame(rows, "s string")
    got = [r.c for r in df.select(EN.clean_fence("s").alias("c")).collect()]
    assert got == ['{"a":1}', '{"a":1}', "x\ny", " ```json\n{}\n```"]


def test_json_damage_statuses(spark):
    rows = [('{"title":"t","content":"c","links":[]}',), ('{"title":"t","content":"c","links":[]',),
            ('{"title":"t","content":"c","links":[]} trailing',), ('[1,2]',),
            ('{"title":"t","content":"c"}',), ('{"title":null,"content":"c","links":null}',),
            ('{"title":"a","title":"b","content":"c","links":[]}',),
            ('{"title":"t","content":"c","links":[]}],[{"x":1}',)]
    df = EN.parse_replies(spark.createDataFrame(rows, "reply string"))
    got = [(r.status, r.entry.title if r.entry else None) for r in df.collect()]
    assert [g[0] for g in got] == ["ok", "bad_json", "bad_json", "not_object", "missing_fields", "ok", "ok",
                                   "bad_json"]
    assert got[6][1] == "b"          # duplicate keys: the last one wins


def test_validator_presence_only(spark):
    df = spark.createDataFrame([('{"title":null,"content":null,"links":null}',), ('{"title":"x"}',)], "s string")
    assert [r.v for r in df.select(EN.has_fields("s").alias("v")).collect()] == [True, False]


def test_entry_expansion_four_rows(spark):
    e = spark.createDataFrame(
        [(1, ("Test Title", "Test Content", [("Link 1", "http://a"), ("Link 2", "http://b")]))],
        f"page_id long, entry {ENTRY.simpleString()}")
    rows = K.expand_entries(e).orderBy("ord").collect()
    assert [r.doc_type for r in rows] == ["title", "content", "link", "link"]
    assert [r.url for r in rows] == ["", "", "http://a", "http://b"]


def test_entry_atomicity(spark):
    e = spark.createDataFrame(
        [(1, ("t", "c", [("a", "u")])), (2, ("t", "c", [("a", None)])), (3, (None, "c", [])),
         (4, ("t", "c", None))],
        f"page_id long, entry {ENTRY.simpleString()}")
    ok = [r.page_id for r in e.where(K.entry_ok()).collect()]
    assert ok == [1]


def test_headings_hierarchy(spark):
    md = "intro line\n# A\na text\n## A1\n### A1x\n## A2\n#### deep\n# B\nb text"
    rows = X.sections(spark.createDataFrame([(1, md)], "page_id long, md string")).orderBy("sec_idx").collect()
    assert [(r.sec_idx, r.level, r.title, r.parent_idx) for r in rows] == [
        (0, 0, None, None), (1, 1, "A", 0), (2, 2, "A1", 1), (3, 3, "A1x", 2),
        (4, 2, "A2", 1), (5, 4, "deep", 4), (6, 1, "B", 0)]
    assert rows[0].body == "intro line" and rows[1].body == "a text" and rows[6].body == "b text"


def test_links_inside_and_outside_nav(spark):
    html = ('<html><body><nav><a href="/n1">Nav <b>one</b></a></nav>'
            '<article><p>see <a class="x" href="/a1">art &amp; <b>bold</b></a></p></article></body></html>')
    p = spark.createDataFrame([(1, "http://h/x", html)], "page_id long, url string, html string")
    rows = X.nav_links(p).orderBy("is_nav", "link_pos").collect()
    assert [(r.is_nav, r.text, r.url) for r in rows] == [(False, "art & bold", "/a1"), (True, "Nav one", "/n1")]
    e = X.page_entries(p).first()
    assert e.title == ""                       # neither <title> nor <h1>
    assert e.content == "see art & bold"       # <article> block only, nav excluded
    assert [l.url for l in e.links] == ["/n1", "/a1"]


def test_text_and_markdown(spark):
    html = ("<html><head><title>T &amp; co</title><style>p{}</style></head><body><!-- c -->"
            "<h1>Head</h1><p>One &copy; two</p><ul><li><a href='x'>q</a></li></ul>"
            '<img alt="pic" src="/i.png"><table><tr><td>c1</td><td>c2</td></tr></table></body></html>')
    df = spark.createDataFrame([(html,)], "html string")
    r = df.select(H.html_to_text("html").alias("t"), H.html_to_markdown("html").alias("m"),
                  H.page_title("html").alias("ti")).first()
    assert r.t.split("\n")[:2] == ["Head", "One © two"]
    assert "# Head" in r.m and "![pic](/i.png)" in r.m and "| c1" in r.m
    assert r.ti == "T & co"


def test_url_keys(spark):
    df = spark.createDataFrame([("http://user:pw@Host.Example.com:8080/p?q=1#f",), ("no-scheme.com/x",),
                                ("HTTPS://UP.EXAMPLE.ORG",)], "url string")
    got = [r.k for r in df.select(U.source_key("url", "2024-05-06 07:08:09").alias("k")).collect()]
    assert got == ["user:pw@Host_Example_com:8080_20240506_070809", "_20240506_070809",
                   "UP_EXAMPLE_ORG_20240506_070809"]


def test_fingerprint_non_ascii(spark):
    import hashlib
    s = "données – 日本語"
    got = spark.createDataFrame([(s,)], "s string").select(fingerprint("s").alias("f")).first().f
    assert got == hashlib.md5(s.encode()).hexdigest()[:8]


def test_rounding_like_python(spark):
    vals = [0.125, 0.375, -0.004, 1.0, 0.745]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.f for r in df.select(fmt2("x").alias("f")).collect()]
    assert got == [f"{v:.2f}" for v in vals]


def test_unicode_strip(spark):
    df = spark.createDataFrame([("　 quit 　",), ("\t exit\n",)], "s string")
    got = [r.s for r in df.select(py_strip("s").alias("s")).collect()]
    assert got == ["quit", "exit"]


def test_chunks_never_split_lines(spark):
    text = "\n".join(["a" * 30] * 10)
    rows = X.text_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), limit=100).collect()
    assert sum(r.n_lines for r in rows) == 10
    assert "\n".join(r.text for r in sorted(rows, key=lambda r: r.chunk_id)) == text
    assert [r.chunk_id for r in sorted(rows, key=lambda r: r.chunk_id)] == [0, 1, 2]


def test_damaged_replies_keep_every_row(spark):
    e = spark.createDataFrame([(i, "t", "c", [("a", "u")]) for i in range(1, 40)],
                              "page_id long, title string, content string, links array<struct<text:string,url:string>>")
    r = EN.damaged_replies(e)
    assert r.count() == 39
    st = {x.page_id: x.status for x in EN.parse_replies(r).collect()}
    assert st[1] == "ok" and st[11] == "bad_json" and st[7] == "missing_fields" and st[5] == "ok"


def test_any_quoting_order_and_entities(spark):
    html = ("<body><article>one &#8217;x&#x2019; &#65;&#0; &rsquo;&amp;lt; <a href='/one'>1</a> <a class=k href=/two>2</a></article>"
            '<article>two <img src="/i.png" alt="pic"><img alt=\'q p\' src=/j.png><a data-x="y" href = "/three" >3</a></article></body>')
    p = spark.createDataFrame([(1, "http://h/x", html)], "page_id long, url string, html string")
    assert [(r.text, r.url) for r in X.page_links(p).orderBy("link_pos").collect()] == [("1", "/one"), ("2", "/two"), ("3", "/three")]
    md = X.page_markdown(p).first().md
    assert all(x in md for x in ("[1](/one)", "[2](/two)", "[3](/three)", "![pic](/i.png)", "![q p](/j.png)"))
    e = X.page_entries(p).first()
    assert e.content == "one ’x’ A&#0; ’&lt; 1 2\ntwo 3"
    assert p.select(H.main_text("html").alias("t")).first().t == e.content
