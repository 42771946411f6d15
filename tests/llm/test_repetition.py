"""Repetition rules against a brute-force count."""

import random
import re

from kbweave.llm.repetition import FIELDS, repetition_rules


def brute(text, min_repeat=8):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(w)
    longest = [0] * n
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and w[i + k] == w[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    three = {k for i in range(n) if longest[i] >= 3 for k in range(i, i + 3)}
    cover = {k for i in range(n) if longest[i] >= min_repeat for k in range(i, i + longest[i])}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    top = max(longest, default=0)
    top = top if top >= min_repeat else 0
    failed = n < 50 or 100 * len(three) > 50 * n
    kept = not failed and len(cover) <= 0.3 * n and top <= 100
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(three), len(cover), top, failed, kept)


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    texts = [None, "", " \n\t ", "a", "a a a a a", "a b a b a b a b\n\na b\r\na b", "x" * 5000, "é ü\x85z q <b>|#\n <b>|#\n <b>|#",
             "p q r " * 90, "one two three four five six seven eight nine ten " * 2]
    for _ in range(60):
        vocab = [f"w{i}" for i in range(rnd.choice([2, 5, 40, 3000]))]
        w = [rnd.choice(vocab) for _ in range(rnd.choice([3, 49, 50, 120, 260]))]
        if rnd.random() < .5:
            a, k = rnd.randrange(len(w)), rnd.choice([2, 7, 8, 9, 30])
            w += w[a:a + k] * rnd.choice([1, 2, 5])
        texts.append(re.sub(" w1", "\nw1", " ".join(w)))
    rows = [(i, t, 7, False) for i, t in enumerate(texts)] + [(None, "a b c", 1, True), (4, "a a a a a", 7, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept boolean").repartition(3)
    got = sorted((tuple(r) for r in repetition_rules(df).collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t, _, _ in rows), key=str)


def test_long_repeats_and_empty_table(spark):
    rnd = random.Random(4)
    passage = " ".join(f"p{rnd.random()}" for _ in range(150))
    clean = " ".join(f"c{rnd.random()}" for _ in range(20000))
    df = spark.createDataFrame([(1, f"{passage} {clean} {passage}"), (2, clean), (3, f"{clean} {clean}")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repetition_rules(df).collect()}
    assert got[1]["longest_repeat"] == 150 and got[1]["n_covered_words"] == 300 and not got[1]["kept"]
    assert got[2]["kept"] and got[3]["longest_repeat"] == 20000 and got[3]["base_failed"]
    assert repetition_rules(df.limit(0)).columns[1:8] == list(FIELDS) and repetition_rules(df.limit(0)).count() == 0
