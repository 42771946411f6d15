"""Line dedup against a direct comparison of all pairs of places."""

import random

import numpy as np
import pytest

from kbweave.llm.linedup import deleted, drop_repeated_lines

SCHEMA = "doc_id long, text string, n_chars long, id int, h string, n_runs int, _new int, _mask string, lens int"


def longest(rows):
    """Per document the longest run from each line on that an earlier place begins too."""
    docs = sorted({(d, t) for d, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    lines = [t.split("\n") for _, t in docs]
    at, out = {}, {}
    for i, ls in enumerate(lines):
        for p, line in enumerate(ls):
            best = 0
            for j, q in at.get(line, ()):
                n, other = 0, lines[j]
                while p + n < len(ls) and q + n < len(other) and ls[p + n] == other[q + n]:
                    n += 1
                best = max(best, n)
            at.setdefault(line, []).append((i, p))
            out.setdefault(docs[i], []).append(best)
    return out


def brute(rows, k, min_chars):
    out = {}
    for (d, t), best in longest(rows).items():
        ls, gone = t.split("\n"), set()
        for p, n in enumerate(best):
            if n >= k and n and sum(map(len, ls[p:p + n])) >= min_chars:
                gone |= set(range(p, p + n))
        runs = sum(1 for g in gone if g - 1 not in gone)
        out[d, t] = ("\n".join(x for i, x in enumerate(ls) if i not in gone), len(ls), len(gone), runs)
    return out


def make():
    rnd = random.Random(8)
    vocab = [f"line {i} é {'x' * (i % 30)}" for i in range(40)] + ["", "short"]
    rows = [(0, None), (1, ""), (2, "\n\n\n\n"), (3, "only"), (None, vocab[7] + "\n" + vocab[8] + "\nq")]
    for i in range(4, 90):
        rows.append((i, "\n".join(rnd.choices(vocab, k=rnd.choice([1, 2, 5, 30])))))
    block = "\n".join(f"short {i:02d}" for i in range(20))                     # 20 lines of 8 characters
    rows += [(200, "\n".join([vocab[29]] * 300)), (201, rows[20][1]), rows[20], (202, "a\n" + block + "\nb"), (203, block + "\nc"),
             (204, "before\n" + "w" * 400 + "\nafter"), (205, "other\n" + "w" * 400 + "\nend"), (206, "w" * 400 + "\nshort\ntail"),
             (207, "x\n" + "w" * 400 + "\nshort\ntail\nnew")]
    long = "\n".join(rnd.choices(vocab, k=700))
    rows += [(300, long), (301, "new\n" + long + "\nmore"), (302, "\n".join(long.split("\n")[100:470]))]
    return rows


@pytest.mark.parametrize(("k", "min_chars"), [(1, 50), (2, 50), (3, 20), (5, 0), (1, 0)])
def test_matches_brute_force(spark, k, min_chars):
    rows = make()
    df = spark.createDataFrame([(d, t, 5, 1, "z", 3, 4, "m", 6) for d, t in rows], SCHEMA).repartition(6)
    out = drop_repeated_lines(df, k, min_chars, report=True)
    assert out.columns == ["doc_id", "text", "n_chars", "id", "h", "_new", "_mask", "lens", "n_lines", "n_removed", "n_runs"]
    want = brute(rows, k, min_chars)
    src = {}
    for d, t in rows:
        src.setdefault(d, []).append(t)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        t = src[r["doc_id"]][0]
        if t is None:
            assert r["text"] is None and r["n_removed"] == 0
            continue
        assert (r["text"], r["n_lines"], r["n_removed"], r["n_runs"]) == want[r["doc_id"], t]
        assert r["n_chars"] == (len(r["text"]) if r["n_removed"] else 5) and r["h"] == "z"


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = drop_repeated_lines(df)
    assert out.columns == df.columns and out.count() == 0


def test_runs_of_short_lines_and_single_long_lines_go(spark):
    block = "\n".join(f"thirteen {i:04d}" for i in range(20))
    line = "y" * 400
    rows = [(1, "a\n" + block), (2, block + "\nb"), (3, "c\n" + line + "\nd"), (4, "e\n" + line + "\nf"), (5, "a\nthirteen 0003\nz")]
    got = {r["doc_id"]: r["text"] for r in drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "b", 3: rows[2][1], 4: "e\nf", 5: rows[4][1]}


def test_limits_on_whole_runs():
    lens, runs = np.array([60, 1, 1, 5, 5], np.int32), np.array([[0, 3], [1, 2], [3, 1]], np.int64)
    assert deleted(lens, runs, 1, 50).tolist() == [True, True, True, False, False]
    assert not deleted(lens, runs, 4, 50).any() and not deleted(lens, runs[1:], 1, 50).any()
