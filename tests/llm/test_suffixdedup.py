"""Repeated strings against a brute-force count of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from kbweave.llm.suffixdedup import COVER, PERIOD, repeated_strings

SCHEMA = "doc_id long, text string, block string, n long"


def brute(texts, match):
    data = [(t or "").encode() for t in texts]
    n = Counter(b[i:i + match] for b in data for i in range(len(b) - match + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - match + 1):
            if n[b[i:i + match]] > 1:
                gone[i:i + match] = b"\1" * match
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def make():
    r = random.Random(9)

    def text(n):
        return "".join(r.choices("abcdeé \n", k=n))
    base = [text(n) for n in (150, 199, 200, 201, 400, 1500, 6000)]
    out = [None, "", *base, base[4], base[5], base[6], "x" * 900, "ab" * 300]
    for _ in range(40):
        a, b = r.choice(base[3:]), r.choice(base[3:])
        i, j = r.randrange(len(a)), r.randrange(len(b))
        out.append(text(r.choice([0, 30, 333])) + a[i:i + r.choice([180, 195, 200, 210, 700])] + text(r.choice([0, 1, 50]))
                   + b[j:j + r.choice([150, 230, 2000])] + text(r.choice([0, 77])))
    for _ in range(12):                               # near copies
        t = list(base[6])
        for _ in range(r.choice([1, 3])):
            t[r.randrange(len(t))] = "Z"
        out.append("".join(t))
    return out


def test_cover_is_perfect():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("block", [4 << 20, 3000])
def test_matches_brute_force(spark, block):
    texts = make()
    rows = [(None if i == 5 else i // 2 if i < 6 else i, t, "q", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = repeated_strings(df, block_bytes=block)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = sorted(((r[0], *b) for r, b in zip(rows, brute(texts, 200), strict=True)), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_empty_table_and_short_match(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repeated_strings(df).count() == 0
    with pytest.raises(ValueError):
        repeated_strings(df, match=100)
