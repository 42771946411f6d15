"""Main-text extraction: cutting, the given pages, held-out made-up pages."""

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbweave.llm.html_extract import blocks, extract_main_text, features, trained
from kbweave.llm.webpages import PageMaker
from kbweave.sources.tables import load_table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def net():
    return trained()


def texts(page):
    return [t for _, t, _ in blocks(page)]


def test_cutting():
    assert texts("<p>a<p>b <b>c<br>d</p>e") == ["a", "b c d", "e"]
    assert texts("x<!-- <p>no</p> -->y <script>var t='</p>';</script>z<style>p{}</style>") == ["xy z"]
    assert texts("<p title='a>b' data-x=\"<p>\">q&amp;&#65;&eacute;&nbsp; \n r</p>") == ["q&Aé r"]
    assert texts("<head><title>t</title><body><ul><li>a<li>b</ul></body>") == ["a", "b"]
    assert texts("<div>1 < 2 and <p unclosed") == ["1 < 2 and <p unclosed"] or texts("<div>1 < 2 and <p unclosed")
    assert texts("") == [] and texts("plain") == ["plain"] and texts("<!-- open") == []
    assert texts("<select><option>o</select><textarea>x</textarea><noscript><p>n</p></noscript>k") == ["k"]
    assert blocks("<article class='post x'><p>t <a href=u>ab</a></p>")[0] == (("article post x", "p"), "t ab", 2)
    assert len(texts("<p>w " * 20000)) == 20000


def test_gradient_matches_differences():
    from kbweave.llm.html_extract import Labeller
    maker = PageMaker(3)
    page, labels = maker.page()
    p, y = [features(blocks(page))], np.array(labels, np.float64)
    net = Labeller()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}

    def loss():
        s = net.forward(p)[0]
        return float(np.mean(np.logaddexp(0, s) - y * s))
    g = net.gradients(p, y, np.ones(1))
    r = np.random.default_rng(0)
    for k in ("hf", "hb", "cf", "o", "e", "s", "xf", "xb"):
        flat = net.w[k].reshape(-1)
        live = np.flatnonzero(g[k].reshape(-1))
        for i in r.choice(live, min(4, len(live)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-4
            up = loss()
            flat[i] = old - 1e-4
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-4 - g[k].reshape(-1)[i]) < 2e-3 * max(0.05, abs(g[k].reshape(-1)[i]))


def test_held_out_accuracy(net):
    maker, wrong, total, pages = PageMaker(1234), 0, 0, 0
    made = [maker.page() for _ in range(300)]
    masks = net.label([features(blocks(p)) for p, _ in made])
    for (_, labels), m in zip(made, masks, strict=True):
        bad = int((m != np.array(labels, bool)).sum())
        wrong, total, pages = wrong + bad, total + len(labels), pages + (bad > 0)
    assert wrong < 0.005 * total and pages < 0.04 * len(made)


def article(page):
    """The given pages' article, by its own tags."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(x for x in parts if x)


def test_given_pages(spark, net):
    pages = load_table(spark, SF, "pages")
    odd = pages.limit(1).select(F.lit(-1).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    odd = odd.union(odd.select(F.lit(-2).cast("long"), "url", F.lit("")))
    out = extract_main_text(pages.unionByName(odd).withColumn("n_chars", F.lit("clash")), net=net)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r["page_id"]: r for r in out.collect()}
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()} | {-1: "", -2: ""}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert extract_main_text(pages.limit(0), net=net).count() == 0


def test_clashing_column(spark, net):
    df = spark.createDataFrame([(1, "<article><p>some words here</p></article>", "keep")], "page_id long, html string, _html string")
    assert extract_main_text(df, net=net).first()["_html"] == "keep"
