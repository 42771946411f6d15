"""Phrase mining against a direct count of all phrases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from kbweave.llm import phrases as P


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", x) for x in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def counts(rows, longest):
    f = defaultdict(Counter)
    for _, text, lang in rows:
        for w in pieces(text):
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return f


def brute(rows, longest, least, top, inside):
    out = []
    for lang, f in counts(rows, longest).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        longer = Counter()
        for p, c in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i:i + m]] = max(longer[p[i:i + m]], c)
        kept = []
        for p, a in cand.items():
            if longer[p] and 100 * longer[p] >= inside * a:
                continue
            s, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def made(n=400, seed=5):
    rng = np.random.default_rng(seed)
    vocab = ["The", "new", "york", "city", "été", "is", "x'y", "don't", "big", "APPLE", "世界", "of", "a-b"]
    rows = []
    for i in range(n):
        w = list(rng.choice(vocab, rng.integers(0, 30)))
        for _ in range(rng.integers(0, 3)):
            w += ["new", "york", "city", "hall"] if rng.random() < 0.5 else ["Big", "apple"]
        text = "".join(x + str(rng.choice([" ", " ", " ", "  ", ", ", ".", "\n", "\t"])) for x in w)
        rows.append((i, text, [None, "en", "en", "de"][i % 4]))
    return rows + [(n, None, "en"), (n + 1, "", None), (None, "new york city", "en"), (n + 2, " .,; ", "de"),
                   (3, rows[3][1], rows[3][2]), (n + 3, "only here", "xx")]


@pytest.mark.parametrize("options", [{}, {"sample": 0.0}, {"sample": 1.0, "sample_count": 1}, {"filter_bits": 64},
                                     {"filter_bits": 1 << 10, "sample": 0.5}])
def test_counts_are_exact_whatever_the_sample(spark, options):
    rows = made()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, phrase int").repartition(3)
    got = P.frequent_phrases(df, 4, 12, **options).collect()
    want = {(lang, " ".join(p)): c for lang, f in counts(rows, 4).items() for p, c in f.items() if c >= 12}
    assert len([r for r in got if r["k"]]) == len(want)
    assert {(r["lang"], r["phrase"]): r["n"] for r in got if r["k"]} == want
    total = Counter()
    for r in got:
        total[r["lang"]] += r["n"] if r["k"] == 0 else 0
    assert total == {lang: sum(c for p, c in f.items() if len(p) == 1) for lang, f in counts(rows, 4).items() if f}


def test_collocations(spark, monkeypatch):
    rows = made(500, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    for top in (1000, 7):
        got = P.collocations(df, 4, 12, 80, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, 4, 12, top, 80)
    assert P.collocations(df.limit(0)).count() == 0


def test_tiles_and_hashes():
    rows = made(60, 2)
    texts = [t or "" for _, t, _ in rows]
    want = counts([(0, t, "en") for t in texts], 3)["en"]
    data, off = P.text_bytes(pa.array(texts))
    cut = P.BREAK[data]
    cut[off[1:-1][off[1:-1] > 0] - 1] = True
    full = P.Bitmap(64)
    full.data[:] = ~np.uint64(0)
    for size in (1, 50, 1 << 20):
        got = Counter()
        for lo, hi in P.tiles(cut, size):
            edges = off[np.searchsorted(off, lo):np.searchsorted(off, hi)] - lo
            for _, phrase, _, n in P._tile_counts(data[lo:hi], edges, b"en", 3, full, None, True):
                for p, c in zip(phrase.to_pylist(), n):
                    got[tuple(p.decode().split(" "))] += int(c)
        assert got == want
    h = P.phrase_hashes("en", pa.array(["a b", "a", "b a", "a b c", "é"]))
    one = {w: int(P._hashes(pa.array([w.encode()], pa.binary()), b"en")[0]) for w in ("a", "b", "c", "é")}
    ab = P._chain(np.array([one["a"]], np.uint64), np.array([one["b"]], np.uint64))
    assert h[0] == ab[0] and h[1] == one["a"] and h[4] == one["é"] and len(set(h.tolist())) == 5
    assert h[3] == P._chain(ab, np.array([one["c"]], np.uint64))[0]
