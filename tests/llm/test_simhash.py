"""SimHash groups against an all-pairs brute force."""

import random
import re

import xxhash

from kbweave.llm.simhash import near_dedup, simhash_groups

SCHEMA = "doc_id long, text string, id string, fp long"


def brute_fp(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                comp[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.setdefault((d, f"{fps[i]:016x}", min(ids) if ids else None), []).append(1)
    return sorted(((k, len(v)) for k, v in out.items()), key=str)


def rows_for_test():
    rnd = random.Random(5)
    vocab = [f"w{i}é" for i in range(400)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "one two three"), (4, "A B C d"), (5, "a b c D"), (6, "  \t\n"),
            (7, "x y" * 3), (7, "x y" * 3), (None, "some text that has no id at all")]
    for g in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([12, 60, 300]))]
        for _ in range(rnd.choice([1, 2, 6, 40])):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 5])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((len(rows) + 100, " ".join(w)))
    rows.append((99, " ".join(rnd.choice(vocab) for _ in range(30000))))
    return rows


def test_groups_match_brute_force(spark):
    rows = rows_for_test()
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA).repartition(5)
    got = {}
    for r in simhash_groups(df).collect():
        got.setdefault(tuple(r), []).append(1)
    assert sorted(((k, len(v)) for k, v in got.items()), key=str) == brute(rows)


def test_empty_table_and_kept_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash_groups(empty).count() == 0
    assert near_dedup(empty).count() == 0
    df = spark.createDataFrame([(5, "a b c d e f", "k", 0), (3, "a b c d e f", "k", 0), (9, "other words here now ok", "k", 1)], SCHEMA)
    kept = near_dedup(df)
    assert kept.columns == ["doc_id", "text", "id", "fp"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 9]
