"""Decontamination: recall against brute force, paraphrases, clean text, edge cases."""

import random
import re

import numpy as np

from kbweave.llm.decontaminate import Settings, benchmark_matches, drop_contaminated, lcs
from kbweave.sources.tables import load_table

SF = "/root/testdata/sf0.01"


def plain(t):
    return " ".join(re.findall(r"[^\W_]+", (t or "").lower()))


def test_lcs_matches_dynamic_programme():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(1, 90))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        n, taken = lcs(np.array(a), np.array(b))
        assert n == t[-1][-1] == taken.sum()
        it = iter(b)
        assert all(x in it for x in np.array(a)[taken].tolist())


def test_whole_items_are_all_found_and_nothing_else(spark):
    docs, bench = load_table(spark, SF, "documents"), load_table(spark, SF, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in benchmark_matches(docs, bench).collect()}
    texts = {r["doc_id"]: plain(r["text"]) for r in docs.collect()}
    true = {(d, r["item_id"]) for r in bench.collect() for d, t in texts.items() if plain(r["text"]) in t}
    assert true <= got and len(got - true) <= len(true) // 10


def test_paraphrases_and_edge_cases(spark):
    rnd = random.Random(6)
    bench = load_table(spark, SF, "benchmark").collect()
    docs = load_table(spark, SF, "documents", ["doc_id", "text"])
    filler = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()]
    long = [b for b in bench if len(b["text"].split()) >= 24][:12]
    rows, want = [], set()
    for n, b in enumerate(long):
        w = b["text"].split()
        for i in rnd.sample(range(len(w)), len(w) // 8):
            w[i] = f"changed{n}x{i}"
        rows.append((10_000 + n, filler[n] + " " + " ".join(w).upper().replace(" ", "\n", 3) + "!! " + filler[n + 1], "x", "y"))
        want.add((10_000 + n, b["item_id"]))
        shuffled = b["text"].split()
        rnd.shuffle(shuffled)
        rows.append((20_000 + n, " ".join(shuffled), "x", "y"))
    rows += [(None, long[0]["text"], "x", "y"), (5, None, "x", "y"), (6, "", None, None), (7, " .,! \n", "", "")]
    rows += [(30_000, long[1]["text"] * 2, "x", "y")] * 2
    want |= {(None, long[0]["item_id"]), (30_000, long[1]["item_id"])}
    more = spark.createDataFrame(rows, "doc_id long, text string, item_id string, cosine string")
    table = more.unionByName(docs, allowMissingColumns=True)
    items = spark.createDataFrame([tuple(b) for b in bench] + [(900, None), (901, ""), (None, "?")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in benchmark_matches(table, items, Settings(block_words=300)).collect()}
    made = {(d, i) for d, i in got if d is None or d >= 10_000}
    assert want <= made and not any(d is not None and 20_000 <= d < 30_000 for d, _ in got)
    assert all(i in {b["item_id"] for b in bench} for _, i in got)
    left = drop_contaminated(more, items)
    assert left.columns == more.columns and not {r["doc_id"] for r in left.collect()} & {d for d, _ in want}


def test_empty_tables(spark):
    docs, bench = load_table(spark, SF, "documents"), load_table(spark, SF, "benchmark")
    assert benchmark_matches(docs.limit(0), bench).count() == 0
    assert benchmark_matches(docs.limit(20), bench.limit(0)).count() == 0
