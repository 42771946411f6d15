"""Helpers the scale claims rest on: query grid, global index, spread, gate."""

from pyspark.sql import functions as F

from kbweave.operators.partitioning import gate, spread
from kbweave.operators import retrieve as R
from kbweave.plans.lookback import global_index, lookback, plain_lookback


def test_topk_plan_does_not_grow_with_queries(spark):
    def nodes(n):
        docs = spark.createDataFrame([(str(i), [float(i % 5), 1.0]) for i in range(60)], "doc_id string, embedding array<float>")
        q = spark.createDataFrame([(i % 3, [1.0, float(i)]) for i in range(n)], "query_id long, embedding array<float>")
        top = R.topk_batch(docs, q, 2, dim=2, block_rows=4)
        assert top.count() == 2 * n                            # repeated query ids are answered each
        return top._jdf.queryExecution().sparkPlan().toString().count("\n")
    assert nodes(6) == nodes(60)


def test_global_index_dense_in_key_order(spark):
    rows = [(k, t) for k in (3, 1, 2) for t in range(0, 50, 5)] + [(9, t) for t in range(400)]
    df = spark.createDataFrame(rows, "k long, t long").repartition(7)
    g = global_index(df, "k", "t", 100, num_partitions=5).select("k", "t", "_g").collect()
    got = [(r.k, r.t) for r in sorted(g, key=lambda r: r._g)]
    assert got == sorted(rows) and sorted(r._g for r in g) == list(range(len(rows)))


def test_lookback_null_key_and_blocks_smaller_than_the_frame(spark):
    rows = [(k, t) for k in (None, 1, None, 2) for t in range(3)] + [(None, 9), (1, 40)]
    rows = sorted(set(rows), key=str) + [(7, t) for t in range(50)]
    df = spark.createDataFrame(rows, "k long, t long")
    want = {(r.k, r.t): [m.t for m in r.h] for r in plain_lookback(df, "k", "t", {"h": 6}, []).collect()}
    for block in (1, 3, 1000):
        got = {(r.k, r.t): [m.t for m in r.h] for r in lookback(df, "k", "t", {"h": 6}, [], block_rows=block).collect()}
        assert got == want


def test_spread_only_on_request(spark):
    df = spark.range(0, 1000, numPartitions=1)
    assert spread(df, None) is df
    assert spread(df, 8).rdd.getNumPartitions() == 8


def test_gate_keeps_rows_without_filter_node(spark):
    df = spark.range(10).withColumn("even", F.col("id") % 2 == 0)
    out = gate(df, F.col("even"))
    assert sorted(r.id for r in out.collect()) == [0, 2, 4, 6, 8]
    assert "Filter" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_steps_see_short_slices(spark):
    """What a step makes of an Arrow batch is bounded by a slice of it, and slices change no result."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    from kbweave.operators import hashing as H
    assert [len(x) for x in H.sliced(iter([pa.array(range(600)), pa.array([1])]))] == [256, 256, 88, 1]
    rows = [(i, None if i % 7 == 0 else ["a b", None if i % 5 == 0 else "b b c"]) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, t array<string>").coalesce(1)
    want = np.array(H.hashed_vectors(16)(["a b", "b b c"]))
    for r in df.select("i", H.dense_texts_udf(16)("t").alias("v")).collect():
        assert r.v is None if r.i % 7 == 0 or r.i % 5 == 0 else (np.array(r.v) == want).all()
    toks = spark.createDataFrame([(i, None if i % 7 == 0 else [] if i % 5 == 0 else ["b", "b", "c"]) for i in range(600)], "i int, t array<string>").coalesce(1)
    for r in toks.select("i", H.sparse_tf_udf(16)("t").alias("s"), H.dense_tf_udf(16)("t").alias("d")).collect():
        assert (r.s is None or r.s.bucket is None) == (r.i % 7 == 0) == (r.d is None)
        if r.d is not None:
            assert sum(r.d) == (0 if r.i % 5 == 0 else 3) == sum(r.s.tf)
    seen = []
    from kbweave.operators import kb as K
    e = spark.range(600).select(F.col("id").alias("page_id"), F.struct(F.lit("t").alias("title"), F.lit("c").alias("content"),
        F.array().cast("array<struct<text:string,url:string>>").alias("links")).alias("entry")).coalesce(1)

    def embed(texts):
        return [[float(len(texts)), 0.0] for _ in texts]
    seen = {r.vectors[0][0] for r in K.judged(e, 2, embed).select("vectors").collect()}
    assert max(seen) <= 256
