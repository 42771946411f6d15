"""Importance resampling against a direct computation."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa

from kbweave.llm.resampling import crc32_all, feature_buckets, rank_documents, resample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def features(t, n=2):
    w = WORDS.findall(lowered(t))
    return [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def brute(docs, target, buckets, percent, min_words, seed):
    def count(texts):
        out = [0] * buckets
        for t in texts:
            for f in features(t)[0]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out
    s, t = count(d[1] for d in docs), count(target)
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    rows = []
    for i, text in docs:
        f, words = features(text)
        w = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    some = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(some[:len(some) * percent // 100])}
    return sorted((tuple(r[:4]) + (rank.get(id(r)),) for r in rows), key=repr)


def test_crc():
    values = [b"", b"a", b"\xc3\xa9t\xc3\xa9 b", b"x" * 300, *(bytes([i, 255 - i]) for i in range(256))]
    assert crc32_all(pa.array(values, pa.binary())).tolist() == [zlib.crc32(v) for v in values]


def test_features_of_tiles():
    texts = ["", None, "One two, three FOUR! five_six", "Ünï 世界 a1", "x", "the " * 60 + "end", "last one"]
    for tile in (1, 7, 20, 1 << 20):
        for n in (1, 2, 3):
            got = [[] for _ in texts]
            for row, bucket, _ in feature_buckets(pa.array(texts), n, 10_000, tile):
                for r, b in zip(row, bucket):
                    got[r].append(b)
            assert [sorted(g) for g in got] == [sorted(zlib.crc32(f.encode()) % 10_000 for f in features(t, n)[0]) for t in texts]


def test_ranks(spark):
    rng = np.random.default_rng(3)
    vocab = ["Alpha", "beta", "gàmma", "delta9", "eps", "世界", "zeta", "the"]
    docs = [(i, " ".join(rng.choice(vocab, rng.integers(0, 25)))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "!?"), (None, "beta eps " * 4), (None, None), (5, docs[5][1])]
    target = ["alpha beta beta", "zeta, THE delta9", None, ""]
    a = spark.createDataFrame([(i, t, "s", i) for i, t in docs], "doc_id long, text string, rank string, _g long").repartition(5)
    b = spark.createDataFrame([(t,) for t in target], "text string")
    got = rank_documents(a, b, buckets=50, percent=25, min_words=5, seed=7)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute(docs, target, 50, 25, 5, 7)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    drawn = resample(a, b, buckets=50, percent=25, min_words=5)
    assert drawn.columns == ["doc_id", "text", "_g", "n_features", "weight", "score", "rank"]
    rows = drawn.collect()
    assert sorted(r["rank"] for r in rows) == [r + 1 for r in range(sum(w[4] is not None for w in want))]
    assert all(r["text"] == dict(docs)[r["doc_id"]] for r in rows)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rank_documents(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert tuple(rank_documents(one, none, percent=100, min_words=1).first())[:2] == (1, 5)
