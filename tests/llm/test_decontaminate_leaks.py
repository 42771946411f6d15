"""Decontamination where items are leaked often, stand beside decoys, or are very short or long."""

import random

import numpy as np

from kbweave.llm.decontaminate import Settings, benchmark_matches, window_scales
from kbweave.sources.tables import load_table

SF = "/root/testdata/sf0.01"


def sources(spark):
    bench = load_table(spark, SF, "benchmark").orderBy("item_id").collect()
    docs = load_table(spark, SF, "documents", ["doc_id", "text"])
    return bench, docs, [r["text"].split() for r in docs.orderBy("doc_id").collect() if r["text"]]


def test_an_item_in_a_third_of_the_documents_is_found_in_all(spark):
    bench, docs, filler = sources(spark)
    rows = [(1_000_000 + i, " ".join(f[:40] + bench[3]["text"].split() + f[40:80])) for i, f in enumerate(filler) if i % 3 == 0]
    table = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    items = spark.createDataFrame([tuple(b) for b in bench], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in benchmark_matches(table, items).collect()}
    assert {(d, bench[3]["item_id"]) for d, _ in rows} <= got


def test_a_copy_beside_a_decoy_of_the_same_words_is_found(spark):
    bench, docs, filler = sources(spark)
    rnd = random.Random(4)
    rows, want = [], set()
    for n, b in enumerate(bench):
        w = b["text"].split()
        decoy = rnd.sample(w, len(w))
        for i in range(2, len(w), 3):        # no three words in a row are the item's
            w[i] = f"changed{n}x{i}" if i % 2 else w[i].upper()
        text = filler[n][:30] + decoy * 2 + w + filler[n][30:60]
        rows.append((1_000_000 + n, " ".join(text)))
        want.add((1_000_000 + n, b["item_id"]))
    table = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    items = spark.createDataFrame([tuple(b) for b in bench], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in benchmark_matches(table, items, Settings(shingle=64)).collect()}
    assert len(want & got) >= 0.9 * len(want), len(want & got)


def test_short_copies_and_altered_long_items_are_found(spark):
    _, docs, filler = sources(spark)
    rnd = random.Random(5)
    vocabulary = sorted({w for f in filler for w in f})
    bench, rows, want = [], [], set()
    for n in range(60):
        w = rnd.sample(vocabulary, (4, 5, 200, 400, 800, 1500)[n % 6])
        bench.append((n, " ".join(w)))
        w = [f"changed{n}x{i}" if len(w) > 5 and i % 8 == 2 else x for i, x in enumerate(w)]
        rows.append((1_000_000 + n, " ".join(filler[n][:30] + w + filler[n][30:60])))
        want.add((1_000_000 + n, n))
    table = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    items = spark.createDataFrame(bench, "item_id long, text string")
    found = benchmark_matches(table, items, Settings(shingle=1500))     # a shingle is a whole item
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert want <= got, sorted(len(bench[i][1].split()) for _, i in want - got)


def test_scales_follow_the_items():
    assert window_scales(np.array([0, 14, 59])) == (16, 32, 64)
    assert window_scales(np.array([2, 5, 800])) == (4, 8, 16, 32, 64, 128, 256, 512, 1024)
    assert window_scales(np.array([0])) == ()
