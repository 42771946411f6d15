"""Shard placement against a direct table fill."""

from collections import Counter

import pytest
import xxhash

from kbweave.llm.sharding import build_table, place, write_shards

NAMES = [f"s{i}" for i in range(7)]


def test_slots_are_even_and_stable():
    t = build_table(NAMES, 251)
    n = Counter(t)
    assert len(t) == 251 and set(n) == set(range(7)) and max(n.values()) - min(n.values()) <= 1
    big, fewer = build_table([f"s{i:02d}" for i in range(20)], 65537), build_table([f"s{i:02d}" for i in range(19)], 65537)
    moved = sum(a != b for a, b in zip(big, fewer, strict=True) if a != 19)
    assert moved < 0.1 * 65537
    w = Counter(build_table({"a": 1, "b": 3}, 251))
    assert 2.9 < w[1] / w[0] < 3.1


def test_bad_tables():
    for bad, size in ((NAMES, 250), ([], 251), (["a", "a"], 251), (NAMES, 7), ({"a": 0}, 251)):
        with pytest.raises(ValueError):
            build_table(bad, size)


def test_place(spark):
    rows = [(i, f"t{i}", "old") for i in range(500)] + [(None, "n", None), (None, "n", None), (3, "t3", "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = place(df, "doc_id", NAMES, 251)
    assert got.columns == ["doc_id", "text", "slot", "shard"]
    out = got.collect()
    table = build_table(NAMES, 251)
    assert len(out) == len(rows) and len({(r["slot"], r["shard"]) for r in out if r["doc_id"] is None}) == 1
    for r in out:
        if r["doc_id"] is not None:
            h = xxhash.xxh64_intdigest(r["doc_id"].to_bytes(8, "little", signed=True), 42)
            h -= (h >> 63) << 64
            assert r["slot"] == h % 251 and r["shard"] == NAMES[table[r["slot"]]]
    assert place(df.limit(0), "doc_id", NAMES, 251).count() == 0


def test_write(spark, tmp_path):
    df = spark.createDataFrame([(i, "x") for i in range(200)], "doc_id long, text string")
    write_shards(df, "doc_id", NAMES, str(tmp_path / "out"), 251)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200


def filled(names, size):
    """The table filled slot by slot: every shard's whole permutation is written out, turns are counted off."""
    import hashlib
    order = []
    for n in names:
        d = hashlib.sha256(n.encode()).hexdigest()
        first, skip = int(d[:16], 16) % size, int(d[16:32], 16) % (size - 1) + 1
        order.append([(first + i * skip) % size for i in range(size)])
        assert sorted(order[-1]) == list(range(size))
    owner, turn = {}, 0
    while len(owner) < size:
        who = turn % len(names)
        slot = next(s for s in order[who] if s not in owner)
        owner[slot] = who
        turn += 1
    return [owner[s] for s in range(size)]


def test_table_against_written_out_permutations():
    for names, size in ((sorted(NAMES), 251), (["a"], 3), (["x", "y", "zz"], 101)):
        assert build_table(names, size) == filled(names, size)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", "b", "c")], "doc_id long, _slot string, _shard string, __ string")
    got = place(df, "doc_id", NAMES, 251)
    assert got.columns == ["doc_id", "_slot", "_shard", "__", "slot", "shard"] and tuple(got.first())[1:4] == ("a", "b", "c")
