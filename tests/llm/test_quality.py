"""Kneser-Ney perplexities against a direct computation."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from kbweave.llm.quality import TRUST, drop_rejected, perplexities, quality_classifier

DOCS = "doc_id long, text string, lang string, n long, fold int"
LABELS = "doc_id long, quality int, toxic int, lang string"


def brute_model(trusted, order=5):
    raw = Counter()
    for t in trusted:
        b = b"\0" * (order - 1) + t.encode()
        raw.update(b[i - order + 1:i + 1] for i in range(order - 1, len(b)))
    c = {order: raw}
    for n in range(order - 1, 0, -1):
        c[n] = Counter(g[1:] for g in c[n + 1])
    disc, ctx = {}, {}
    for n, t in c.items():
        k = Counter(min(v, 5) for v in t.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] else .5
        disc[n] = {i: min(max(i - (i + 1) * y * k[i + 1] / k[i], .05), i - .05) if k[i] else i * .5 for i in (1, 2, 3)}
        ctx[n] = defaultdict(lambda: [0, 0.0])
        for g, v in t.items():
            ctx[n][g[:-1]][0] += v
            ctx[n][g[:-1]][1] += disc[n][min(v, 3)]

    def p(g):
        n = len(g)
        low = p(g[1:]) if n > 1 else 1 / 256
        if g[:-1] not in ctx[n]:
            return low
        s, held = ctx[n][g[:-1]]
        v = c[n].get(g, 0)
        return ((v - disc[n][min(v, 3)] if v else 0) + held * low) / s
    return p


def perplexity(p, text, order=5):
    b = b"\0" * (order - 1) + text.encode()
    n = len(b) - order + 1
    return math.exp(-sum(math.log(p(b[i:i + order])) for i in range(n)) / n) if n else None


def corpus():
    rnd = random.Random(1)
    syl = {"en": ["the", "an", "er", "on", "th"], "fr": ["é", "eau", "le", "que", "ou"]}
    docs, labels = [], []
    for i in range(160):
        lang = "fr" if i % 4 == 0 else "en"
        words = ["".join(rnd.choices(syl[lang], k=rnd.randint(1, 3))) for _ in range(rnd.choice([3, 30, 80]))]
        junk = i % 10 == 3
        docs.append((i, " ".join(w + "%%#" if junk else w for w in words), lang, 0, 9))
        if i % 3:
            labels.append((i, 0 if junk else 1, 1 if i % 17 == 0 else 0, "zz"))
    docs += [(900, None, "en", 0, 0), (901, "", None, 0, 0), (902, "x", None, 0, 0), (None, "the an", "en", 0, 0),
             (5, docs[5][1], "en", 0, 9), (903, "the an er " * 20000, "de", None, None)]
    labels += [(1, 1, 0, None), (2, 0, 0, None), (None, 1, 0, None), (4, None, None, None)]
    return docs, labels


def test_perplexities_match(spark):
    docs, labels = corpus()
    df, lab = spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)
    for slots in (1, 1048573):                       # nearly all grams joined; nearly all broadcast
        got = perplexities(df, lab, slots=slots).collect()
        assert len(got) == len(docs)
        fold = {r["id"]: r["fold"] for r in got}
        text = {d[0]: d[1] or "" for d in docs}
        p = brute_model([d[1] or "" for d in docs if d[0] is not None and fold[d[0]] == TRUST])
        for r in got:
            want = perplexity(p, text[r["id"]])
            assert (r["perplexity"] is None) == (want is None)
            assert want is None or abs(r["perplexity"] - want) < 1e-9 * want


def test_rejects_junk(spark):
    docs, labels = corpus()
    df, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    out = quality_classifier(df, lab, least_trusted=5)
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert not any(kept[i] for i in range(3, 160, 10)) and not kept[900] and not kept[901]
    assert sum(kept[i] for i in range(160) if i % 10 != 3) >= 140
    left = drop_rejected(df, out)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {k for k, v in kept.items() if v}


def test_empty_tables(spark):
    docs, labels = corpus()
    df, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    assert quality_classifier(df.limit(0), lab).count() == 0
    out = quality_classifier(df, lab.limit(0))
    assert out.where(F.col("threshold").isNotNull()).count() == 0 and out.where("not kept").count() == 2
