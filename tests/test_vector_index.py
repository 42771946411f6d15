"""Pruned blocks and the stored index against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kbweave.operators import retrieve as R
from kbweave.operators import vector_blocks as B
from kbweave.operators import vector_index as VI

E = "/root/testdata/sf0.1/embeddings.parquet"


def made(n=400, dim=6, seed=1):
    """Clustered vectors with exact copies, a third of them one vector, and zero vectors."""
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(9, dim)) * 5
    v = heads[rng.integers(0, 9, n)] + rng.normal(size=(n, dim)) * 0.5
    v[rng.choice(n, n // 3, replace=False)] = v[0]
    v[rng.choice(n, 5, replace=False)] = 0.0
    return v.astype(np.float32)


def brute(docs, queries, k):
    def unit(m):
        m = m.astype(np.float64)
        norm = np.linalg.norm(m, axis=1)
        return m / np.where(norm > 0, norm, 1)[:, None], norm > 0
    d, d_ok = unit(docs)
    q, q_ok = unit(queries)
    s = np.round(q @ d.T, 10)
    out = {}
    for i in range(len(q)):
        key = [(not (q_ok[i] and d_ok[j]), -s[i, j] if q_ok[i] and d_ok[j] else 0.0, j) for j in range(len(d))]
        out[i] = [j for *_, j in sorted(key)[:k]]
    return out


def frame(spark, v, name="doc_id"):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], f"{name} long, embedding array<float>").repartition(3)


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["doc_id"])
    return out


@pytest.mark.parametrize("cells,n_probe,block", [(1, None, 50), (7, 1, 20), (7, 3, 1000), (30, 2, 16), (400, 5, 8), (7, 7, 20)])
def test_pruned_search_is_exact(spark, cells, n_probe, block):
    v = made()
    q = np.concatenate([v[:60], np.zeros((1, 6), np.float32), -v[:5]])
    got = R.topk_batch(frame(spark, v), frame(spark, q, "query_id"), 4, dim=6, cells=cells, n_probe=n_probe, block_rows=block)
    assert lists(got) == brute(v, q, 4)


def test_more_neighbours_than_directions(spark):
    v = made(30)
    got = R.topk_batch(frame(spark, v), frame(spark, v, "query_id"), 29, dim=6, cells=4, n_probe=1, block_rows=5)
    assert lists(got) == brute(v, v, 29)


def test_bounds_hold():
    v = made(300)
    u, ok = B.unit_rows(v)
    centers = B.fit_centers(v, 12, 3)
    own = np.argmax(u @ centers.T, axis=1)
    cos = np.array([min((u[(own == c) & ok] @ centers[c]).tolist(), default=1.0) for c in range(len(centers))])
    bound = B.Cells(centers, cos, np.ones(len(centers) + 1)).bounds(u @ centers.T)
    s = u @ u.T
    for c in range(len(centers)):
        member = (own == c) & ok
        if member.any():
            assert (s[:, member].max(axis=1)[ok] <= bound[ok, c] + 1e-9).all()


def test_index_store_open_append(spark, tmp_path):
    v = made(300, 6, 7)
    first = VI.build_index(frame(spark, v[:200]), str(tmp_path / "i"), dim=6, cells=8, block_rows=25)
    later = spark.createDataFrame([(i, v[i].tolist()) for i in range(200, 300)], "doc_id long, embedding array<float>")
    VI.append_index(first, later)
    index = VI.open_index(spark, str(tmp_path / "i"))
    assert int(index.cells.rows.sum()) == 300 and index.blocks(spark).agg(F.sum(F.size("ids"))).first()[0] == 300
    q = frame(spark, v, "query_id")
    want = brute(v, v, 3)
    assert lists(VI.topk_indexed(index, q, 3)) == want
    assert lists(VI.topk_indexed(index, q, 3, n_probe=2, exact=True)) == want
    near = lists(VI.topk_indexed(index, q, 3, n_probe=4))
    assert np.mean([len(set(near.get(i, [])) & set(w)) / 3 for i, w in want.items()]) > 0.9
    assert VI.topk_indexed(index, q.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        VI.topk_indexed(index, q, 0)


def test_recall_on_the_given_vectors(spark, tmp_path):
    e = spark.read.parquet(E).select("vec_id", "embedding")
    index = VI.build_index(e, str(tmp_path / "i"), id_col="vec_id", dim=64, cells=100)
    n = VI.choose_probes(index, e.where("vec_id % 20 = 3"), 10, query_id="vec_id")
    want = lists(R.topk_batch(e, e, 10, doc_id="vec_id", query_id="vec_id", dim=64))
    got = lists(VI.topk_indexed(index, e, 10, query_id="vec_id", n_probe=n))
    recall = np.mean([len(set(got.get(i, [])) & set(w)) / len(w) for i, w in want.items()])
    assert recall >= 0.9 and n < index.cells.n, (recall, n)
    assert lists(VI.topk_indexed(index, e, 10, query_id="vec_id")) == want


def test_probes_are_chosen_by_one_exact_search(spark, tmp_path, monkeypatch):
    """As many cells as searches with 1, 2, 4... cells would tell, from two rounds of one search."""
    v = made(400, 6, 8)
    e = frame(spark, v).withColumn("query_id", F.col("doc_id"))
    index = VI.build_index(e, str(tmp_path / "i"), dim=6, cells=12, block_rows=25)
    exact = VI.topk_indexed(index, e, 5)
    share = {n: VI.found_share(VI.topk_indexed(index, e, 5, n_probe=n), exact).first() for n in (1, 2, 4, 8)}
    rounds, search = [], B.search
    monkeypatch.setattr(B, "search", lambda *a, **b: rounds.append(1) or search(*a, **b))
    for recall in (0.1, 0.6, 0.8, 0.9, 0.97, 1.0):
        want = next((n for n, r in share.items() if r["found"] >= recall * r["wanted"]), index.cells.n)
        rounds.clear()
        assert VI.choose_probes(index, e, 5, recall=recall) == want and len(rounds) <= 2, recall


def test_vectors_travel_once(spark):
    """Rows that are shuffled: each document in one block; a query only where it is needed."""
    v = made(400)
    d = R.vector_rows(frame(spark, v), "doc_id", "embedding", 6)
    grouped, cells = B.group(d, 400, 9, 6)
    stored = B.blocks(grouped, cells, 6, 20)
    assert stored.agg(F.sum(F.size("ids"))).first()[0] == 400
    q = frame(spark, v, "query_id").select(F.col("query_id").alias("qid"), F.col("embedding").alias("vec"))
    probed = B.packs(q, cells, 6, 20, 1)
    per_query = probed.select("cell", F.explode("qids").alias("qid")).groupBy("qid").agg(F.countDistinct("cell").alias("n"))
    assert per_query.agg(F.max("n")).first()[0] == 1
    thr = q.withColumn("thr", F.lit(0.999))
    rest = B.packs(thr, cells, 6, 20, 1, rest=True).select("cell", F.explode("qids").alias("qid")).distinct().count()
    assert rest < 400 * (cells.n - 1) / 4


def test_empty_tables(spark):
    v = made(10)
    none = frame(spark, v).limit(0)
    assert R.topk_batch(none, frame(spark, v, "query_id"), 3, dim=6).count() == 0
    assert R.topk_batch(frame(spark, v), none.withColumnRenamed("doc_id", "query_id"), 3, dim=6).count() == 0
    assert R.topk_batch(none, frame(spark, v, "query_id"), 3, dim=6, cells=3).count() == 0


def test_part_equals_brute_force():
    """Several chunks of rows, copies, zero vectors, ids out of order."""
    v = np.concatenate([made(3000, 6, 3), np.random.default_rng(2).normal(size=(3000, 6)).astype(np.float32)])
    ids = np.random.default_rng(5).permutation(len(v))
    part = B.Part(pa.array(ids), v)
    by_id = np.empty_like(v)
    by_id[ids] = v
    q = np.concatenate([v[2990:3040], np.zeros((1, 6), np.float32), v[:3]])
    cols, sim, rows = part.best(q, 5)
    got = {i: [] for i in range(len(q))}
    for c, _, r in sorted(zip(cols.tolist(), (-sim).tolist(), rows.tolist(), strict=True)):
        got[c].append(part.ids[r].as_py())
    assert got == brute(by_id, q, 5)


def test_queries_travel_by_part_not_by_block():
    """Small blocks do not multiply the queries: a cell's blocks are dealt to a few parts."""
    cells = B.one_cell(64, 1_000_000)
    rows = B.part_rows(cells, 64, 128, 24, "<f4")
    assert cells.shares(rows).sum() - 1 == 24 and cells.shares(128)[0] > 7000
    assert B.part_rows(B.one_cell(64, 10 ** 9), 64, 128, 24, "<f4") == B.PART_BYTES // 256
    assert B.part_rows(B.one_cell(64, 10), 64, 128, 24, "<f4") == 128


def test_few_parts_and_lanes_share_the_queries():
    """As many queries as documents, 24 slots and nothing pruned: neither side is copied once a task."""
    cells = B.Cells(np.eye(16), np.full(16, -1.0), np.array([3200] * 16 + [0]))
    rows, lanes = B.grid(cells, 64, 100, 24, "<f4", 51_200, 17)
    parts = B.part_numbers(cells, rows)[2]
    assert parts * lanes >= 12 and parts + lanes <= 8
    rows, lanes = B.grid(cells, 64, 100, 24, "<f4", 51_200, 2)                  # two cells a query: documents travel once
    assert lanes == 1
    rows, lanes = B.grid(cells, 64, 100, 24, "<f4", 100, 17)                    # few queries: documents travel once
    assert lanes == 1 and B.part_numbers(cells, rows)[2] >= 16


def test_lanes_answer_like_brute_force(spark, monkeypatch):
    """Cells of a part together, a large cell in several parts, several lanes."""
    v = made(500, 6, 11)
    for rows, lanes in ((60, 3), (500, 5), (90, 1)):
        monkeypatch.setattr(B, "grid", lambda *a, rows=rows, lanes=lanes: (rows, lanes))
        got = R.topk_batch(frame(spark, v), frame(spark, v, "query_id"), 5, dim=6, cells=9, n_probe=2, block_rows=20)
        assert lists(got) == brute(v, v, 5)


def test_no_query_goes_through_the_driver(spark, tmp_path):
    """Joins on the queries are merges whatever the broadcast limit is."""
    v = made(200)
    index = VI.build_index(frame(spark, v), str(tmp_path / "i"), dim=6, cells=4, block_rows=25)
    q = frame(spark, v, "query_id")
    for top in (VI.topk_indexed(index, q, 3, n_probe=1, exact=True), R.topk_batch(frame(spark, v), q, 3, dim=6, cells=4, n_probe=1),
                VI.found_share(VI.topk_indexed(index, q, 3), VI.topk_indexed(index, q, 3))):
        assert "Broadcast" not in top._jdf.queryExecution().executedPlan().toString()


class _Counted(np.ndarray):
    """Rows that count the pairs they are multiplied for."""
    pairs = 0

    def __matmul__(self, x):
        _Counted.pairs += len(self) * x.shape[1]
        return np.asarray(self) @ x


def _peaked(rng, n, dim):
    """Mostly rows along a coordinate (either way), some along two, some without any direction of their own."""
    v = np.zeros((n, dim), np.float32)
    v[np.arange(n), rng.integers(0, dim, n)] = rng.choice([-3.0, 1.0, 2.0], n)
    v[: n // 10, 0] += rng.integers(0, 3, n // 10)
    v[n // 10: n // 5] = rng.normal(size=(n // 5 - n // 10, dim))
    v[-4:] = 0.0
    return v[rng.permutation(n)]


@pytest.mark.parametrize("n,k,box,tile", [(300, 3, 64, 2048), (300, 5, 7, 33), (40, 60, 4, 9), (5, 2, 64, 2048)])
def test_boxes_leave_out_no_winner(monkeypatch, n, k, box, tile):
    monkeypatch.setattr(B, "BOX_ROWS", box)
    monkeypatch.setattr(B, "TILE_ROWS", tile)
    rng = np.random.default_rng(n + k)
    v, q = _peaked(rng, n, 8), np.concatenate([_peaked(rng, 30, 8), rng.normal(size=(20, 8)).astype(np.float32)])
    part = B.Part(pa.array(range(n), pa.int64()), v)
    cols, sim, rows = part.best(q, k)
    want = brute(v, q, k)
    keep = B.local_topk(cols, sim, rows, k)
    got = {i: rows[keep][cols[keep] == i].tolist() for i in range(len(q))}
    assert got == want
    # With what each query has already, rows that reach it are found still, ties too.
    least = np.array([sorted(sim[cols == i])[0] if (cols == i).any() else -np.inf for i in range(len(q))])
    cols, sim, rows = part.best(q, k, np.where(np.isfinite(least), least, -np.inf))
    keep = B.local_topk(cols, sim, rows, k)
    assert {i: rows[keep][cols[keep] == i].tolist() for i in range(len(q))} == want


def test_boxes_that_cannot_win_are_not_compared():
    rng = np.random.default_rng(5)
    v = np.zeros((6000, 32), np.float32)
    v[np.arange(6000), rng.integers(0, 32, 6000)] = 1.0
    v[:300] = rng.random((300, 32)) + 0.5
    q = (rng.random((50, 32)) + 0.5).astype(np.float32)
    part = B.Part(pa.array(range(6000), pa.int64()), v)
    part.unit, _Counted.pairs = part.unit.view(_Counted), 0
    cols, _, rows = part.best(q, 3)
    assert _Counted.pairs < 0.4 * 6000 * 50, _Counted.pairs
    want = brute(v, q, 3)
    assert all(sorted(rows[cols == i].tolist()) == sorted(want[i]) for i in range(50))


def test_likely_pairs_hold_the_best_of_each_query():
    rng = np.random.default_rng(6)
    q, true = rng.integers(0, 7, 400), np.round(rng.random(400), 2)
    keep = B.likely(q, (true + rng.uniform(-0.01, 0.01, 400)).astype(np.float32), 3, 0.0101)
    for i in range(7):
        least = sorted(true[q == i])[-3]
        assert set(np.flatnonzero((q == i) & (true >= least))) <= set(keep.tolist())
    assert len(keep) < 200 and len(B.likely(q[:0], np.zeros(0, np.float32), 3, 0.1)) == 0


def test_uneven_cells_get_more_lanes():
    cells = B.Cells(np.zeros((15, 64)), np.ones(15), np.r_[np.full(15, 30_000), 0])
    rows, lanes = B.grid(cells, 256, 8192, 12, "<f4", 70_000, 16)
    assert B.part_numbers(cells, rows)[2] * lanes >= 24
    assert B.grid(cells, 256, 8192, 12, "<f4", 100, 16)[1] == 1                 # few queries: documents travel once
