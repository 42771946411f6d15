"""Cosine, top-k ordering rules and the blocked scorer against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbweave.functions import vectors as V
from kbweave.operators import retrieve as R
from kbweave.operators import vector_blocks as B


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, embedding array<float>")


def test_order_of_three_vectors(spark):
    # Fixed fixture values: identical, opposite and close to the query; k = 2.
    d = _docs(spark, [(1, [0.1, 0.2, 0.3]), (2, [-0.1, -0.2, -0.3]), (3, [0.05, 0.15, 0.25])])
    top = R.topk_single(d, [0.1, 0.2, 0.3], 2).orderBy("rank").collect()
    assert [r.doc_id for r in top] == [1, 3]
    assert math.isclose(top[0].similarity, 1.0, abs_tol=1e-9)


def test_zero_vector_is_null_and_last(spark):
    d = _docs(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])])
    top = R.topk_single(d, [1.0, 0.0], 3).orderBy("rank").collect()
    assert [r.doc_id for r in top] == [2, 3, 1]
    assert top[2].similarity is None


def test_ties_break_by_doc_id(spark):
    d = _docs(spark, [(5, [1.0, 0.0]), (2, [2.0, 0.0]), (9, [3.0, 0.0]), (1, [0.0, 1.0])])
    top = R.topk_batch(d, spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>"),
                       2, dim=2).orderBy("rank").collect()
    assert [r.doc_id for r in top] == [2, 5]


def test_k_bounds(spark):
    d = _docs(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    assert R.topk_single(d, [1.0, 0.0], 0).count() == 0
    assert R.topk_single(d, [1.0, 0.0], 10).count() == 2
    with pytest.raises(ValueError):
        R.topk_single(d, [1.0, 0.0], -1)


def test_wrong_dimension_rejected(spark):
    d = _docs(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])])
    ok = d.select("doc_id", V.dim_ok("embedding", 2).alias("ok")).orderBy("doc_id").collect()
    assert [r.ok for r in ok] == [True, False]
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert {r.doc_id for r in R.topk_batch(d, q, 5, dim=2).collect()} == {1}


@pytest.mark.parametrize("block_rows,score_bytes", [(None, None), (7, None), (None, 8 * 25 * 3)])
def test_batch_equals_brute_force(spark, monkeypatch, block_rows, score_bytes):
    if score_bytes:                      # tiny budget: every batch is scored in 3-row slices
        monkeypatch.setattr(B, "SCORE_BYTES", score_bytes)
    rng = np.random.default_rng(3)
    base = rng.integers(-3, 4, size=(60, 4)).astype(float)   # small integers: many exact ties
    base[5] = 0.0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    d = _docs(spark, rows).repartition(3)
    q = spark.createDataFrame(rows[:25], "query_id long, embedding array<float>")
    got = {(r.query_id, r.rank): r.doc_id
           for r in R.topk_batch(d, q, 4, dim=4, block_rows=block_rows).collect()}
    for qi in range(25):
        sims = []
        for di, v in enumerate(base):
            nq, nd = np.linalg.norm(base[qi]), np.linalg.norm(v)
            s = None if nq == 0 or nd == 0 else round(float(base[qi] @ v / (nq * nd)), 12)
            sims.append((0 if s is not None else 1, -(s or 0.0), di))
        want = [di for _, _, di in sorted(sims)[:4]]
        assert [got[(qi, r)] for r in range(1, 5)] == want


def test_text_retrieval_prefers_shared_words(spark):
    docs = spark.createDataFrame([(1, "red apples and pears"), (2, "blue sky"), (3, "")],
                                 "doc_id long, text string")
    q = spark.createDataFrame([(10, "apples"), (11, "SKY blue!")], "query_id long, text string")
    top = {(r.query_id, r.rank): r.doc_id for r in R.topk_text(docs, q, 1, dim=64).collect()}
    assert top == {(10, 1): 1, (11, 1): 2}


def test_cosine_column(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    got = [r.c for r in df.select(V.cosine("a", "b").alias("c")).collect()]
    assert got[0] == 0.0 and math.isclose(got[1], 1.0)


def test_text_retrieval_many_blocks_equals_one(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} common {'x' * (i % 3)}") for i in range(40)],
                                 "doc_id long, text string")
    q = spark.createDataFrame([(i, f"w{i % 7} common") for i in range(30)], "query_id long, text string")
    one = {(r.query_id, r.rank): (r.doc_id, r.similarity) for r in R.topk_text(docs, q, 3, dim=32).collect()}
    from kbweave.config import Params
    many = R.topk_batch(docs.select("doc_id", R.tokens("text").alias("t")),
                        q.select("query_id", R.tokens("text").alias("t")), 3, doc_vec="t", query_vec="t",
                        dim=32, kind="tokens", block_rows=4, params=Params())
    got = {(r.query_id, r.rank): (r.doc_id, r.similarity) for r in many.collect()}
    assert got == one
