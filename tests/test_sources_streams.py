"""File sources and sinks, schema assertion, and streaming vs batch."""

import json
import os
import uuid

import pytest

from kbweave.config import checkpoint_root
from kbweave.sources import files as FS
from kbweave.streaming import jobs as ST


def _tmp(spark, name):
    return f"{checkpoint_root(spark)}/test-{name}-{uuid.uuid4().hex[:8]}"


def _local(p):
    return p[len("file:"):] if p.startswith("file:") else p


def test_text_files_whole(spark):
    d = _local(_tmp(spark, "md"))
    os.makedirs(d)
    with open(f"{d}/a.md", "w", encoding="utf-8") as f:
        f.write("# Title\nline\n[link](http://x)")
    rows = FS.read_text_files(spark, d).collect()
    assert len(rows) == 1 and rows[0].md.startswith("# Title\nline")


def test_many_text_files_by_group(spark, monkeypatch):
    """The driver lists one group of files at a time; the rows are those of one folder, whatever stood there before."""
    monkeypatch.setattr(FS, "GROUP_FILES", 10)
    listed, texts = [], FS._texts
    monkeypatch.setattr(FS, "_texts", lambda s, at, **o: listed.append(at) or texts(s, at, **o))
    rows = [(i, f"# page {i}\nä") for i in range(38)] + [(3, "once more"), (None, "no key")]
    df = spark.createDataFrame(rows, "page_id long, md string").repartition(3)
    p = _tmp(spark, "md-files")
    FS.write_markdown_files(df.limit(4), p, "page_id")
    for _ in range(2):
        FS.write_markdown_files(df, p, "page_id")                          # in place of the four, and of itself
        groups, others = FS.file_groups(spark, p)
        assert others == 0 and 2 <= len(groups) <= 4
        got = [(r.path, r.md) for r in FS.read_text_files(spark, p).collect()]
        assert len(got) == 39 and sorted("".join(m for _, m in got).split("\n")) == sorted("".join(m + "\n" for _, m in rows).split("\n"))
        assert all(f"page_id={m.split()[2]}/" in at for at, m in got if m.startswith("# page") and "once" not in m)
    assert sorted(listed) == sorted(2 * groups)
    FS.write_markdown_files(df.where("page_id < 2"), p, "page_id", mode="append")
    assert FS.read_text_files(spark, p).count() == 41                      # single files beside the groups
    FS.write_markdown_files(df, p, "page_id", mode="ignore")
    assert FS.read_text_files(spark, p).count() == 41
    with pytest.raises(Exception, match="already exists"):
        FS.write_markdown_files(df, p, "page_id", mode="errorifexists")


def test_json_object_or_array(spark):
    d = _local(_tmp(spark, "json"))
    os.makedirs(d)
    e = {"title": "t", "content": "é", "links": [{"text": "a", "url": "u"}]}
    with open(f"{d}/one.json", "w", encoding="utf-8") as f:
        json.dump(e, f, ensure_ascii=False, indent=2)
    with open(f"{d}/many.json", "w", encoding="utf-8") as f:
        json.dump([e, e], f, ensure_ascii=False, indent=2)
    assert FS.read_entries_json(spark, d).count() == 3


def test_kb_append_keeps_duplicates_unless_asked(spark):
    from kbweave.operators.kb import kb_rows
    from kbweave.schemas import ENTRY
    schema = f"page_id long, entry {ENTRY.simpleString()}"
    docs = kb_rows(spark.createDataFrame([(2**62, ("t", "c", [("a", "u")]))], schema), 8)
    changed = kb_rows(spark.createDataFrame([(2**62, ("t", "new", [("a", "u")]))], schema), 8)
    p = _tmp(spark, "kb")
    FS.append_kb(docs, p, dedup=True)                         # nothing stored yet
    FS.append_kb(docs, p)
    assert spark.read.parquet(p).count() == 6
    FS.append_kb(docs, p, dedup=True)
    assert spark.read.parquet(p).count() == 6
    FS.append_kb(changed, p, dedup=True)                      # an updated page is stored
    stored = [r.text for r in spark.read.parquet(p).where("ord = 1").collect()]
    assert sorted(stored) == ["c", "c", "new"]
    with pytest.raises(ValueError):
        FS.assert_schema(docs.drop("url"))


def test_failed_embedding_rejects_its_entry_whole(spark):
    from kbweave.operators.kb import kb_rows
    from kbweave.schemas import ENTRY
    e = spark.createDataFrame([(1, ("t", "c", [("a", "u")])), (2, ("bad", "c", [])), (3, ("t", "wide", [])), (4, (None, "c", []))],
                              f"page_id long, entry {ENTRY.simpleString()}").coalesce(1)

    def embed(texts):
        if "bad" in texts:
            raise RuntimeError("down")
        return [[1.0] * (3 if t == "wide" else 2) for t in texts]
    rows = kb_rows(e, 2, embed).collect()
    assert [(r.page_id, r.ord, r.embedding) for r in rows] == [(1, i, [1.0, 1.0]) for i in range(3)]


def test_stream_history_over_shuffled_files_and_small_chunks(spark):
    from pyspark.sql import functions as F
    from kbweave.plans.lookback import plain_lookback
    d = _tmp(spark, "conv-many")
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for c in range(2) for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.orderBy(F.xxhash64("conv_id", "turn")).repartition(4).write.parquet(d)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    out, ckpt = _tmp(spark, "hist-out"), _tmp(spark, "hist-ckpt")
    try:
        assert ST.history_stream(spark, d, out=out, ckpt=ckpt) == out
        ST.history_stream(spark, d, out=out, ckpt=ckpt)       # a restart has nothing left to do
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = plain_lookback(df, "conv_id", "turn", {"h": 6}, ["role", "text"]).select(
        "conv_id", "turn", F.size("h").alias("n"),
        F.array_join(F.transform("h", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n").alias("s"))
    got = sorted((r.conv_id, r.turn, r.hist_len, r.history) for r in spark.read.parquet(out).collect())
    assert got == sorted(tuple(r) for r in want.collect())


def test_stream_history_state_is_bounded(spark):
    from pyspark.sql import functions as F
    from kbweave.plans.lookback import plain_lookback
    d = _tmp(spark, "conv")
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for c in range(3) for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(d)
    out = ST.history_stream(spark, d)
    got = {(r.conv_id, r.turn): (r.hist_len, r.history) for r in spark.read.parquet(out).collect()}
    want = plain_lookback(df, "conv_id", "turn", {"h": 6}, ["role", "text"]).select(
        "conv_id", "turn", F.size("h").alias("n"),
        F.array_join(F.transform("h", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n").alias("s"))
    assert got == {(r.conv_id, r.turn): (r.n, r.s) for r in want.collect()}


def test_markdown_and_entry_sinks_roundtrip(spark):
    from pyspark.sql import functions as F
    from kbweave.functions.text import fingerprint
    from kbweave.schemas import ENTRY
    md = spark.createDataFrame([("host_x_20240101_000000", "# T\nés")], "source_key string, md string")
    p = _tmp(spark, "mdsink")
    FS.write_markdown(md, p)
    assert spark.read.parquet(p).first().md == "# T\nés"
    e = spark.createDataFrame([(("Tï", None, [("a", "u")]),)], f"entry {ENTRY.simpleString()}") \
        .select("entry.*").withColumn("fingerprint", fingerprint("title"))
    j = _tmp(spark, "jsonsink")
    FS.write_entries_json(e, j)
    raw = "".join(r.value for r in spark.read.text(j).collect())
    assert "Tï" in raw and '"content":null' in raw          # UTF-8 kept, nulls written
    back = FS.read_entries_json(spark, j, lines=True).first()
    assert back.title == "Tï" and back.links[0].url == "u"


def test_dense_hashing_matches_sparse_counts(spark):
    from pyspark.sql import functions as F
    from kbweave.operators import kb as K
    df = spark.createDataFrame([(1, "Apple apple, PEAR! 42 pear"), (2, ""), (3, None)], "doc_id long, text string")
    sparse = {(r.doc_id, r.bucket): r.tf for r in K.hashed_tf(df, "doc_id", "text", 16).collect()}
    dense = {r.doc_id: r.embedding for r in K.embed_hashed(df, "text", 16).collect()}
    for (d, b), tf in sparse.items():
        assert dense[d][b] == tf
    assert sum(dense[1]) == 5 and sum(dense[2]) == 0


def test_user_embedder_in_batches(spark):
    from kbweave.operators import kb as K
    from kbweave.schemas import ENTRY

    def embed(texts):                     # runs in the Python worker
        return [[float(len(t)), float(len(texts))] for t in texts]
    e = spark.createDataFrame([(i, ("x" * i, "c", [])) for i in range(1, 8)], f"page_id long, entry {ENTRY.simpleString()}").coalesce(1)
    out = {r.page_id: r.vectors for r in K.embed_entries(e, 2, embed, batch_size=3).collect()}
    assert out[5][0][0] == 5.0 and max(v[1] for vs in out.values() for v in vs) <= 3


def test_foreach_batch_sink_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    p = _tmp(spark, "epochs")
    ST.write_epoch(df, p, 0)
    ST.write_epoch(df, p, 0)          # replay of the same micro-batch
    ST.write_epoch(df.limit(1), p, 1)
    back = spark.read.parquet(p)
    assert back.count() == 3 and sorted(r.epoch for r in back.collect()) == [0, 0, 1]


def test_continuous_history_stream_with_idle_timeout(spark):
    from pyspark.sql import functions as F
    from kbweave.config import Params
    d = _tmp(spark, "conv-cont")
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for c in range(2) for t in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(d)
    import time
    out, q = ST.history_stream(spark, d, Params(state_idle_ms=60_000), processing_time="1 second")
    # With pending idle timeouts the query keeps running no-data batches, so
    # processAllAvailable() would not return: poll the sink instead.
    try:
        for _ in range(60):
            time.sleep(1)
            try:
                if spark.read.parquet(out).count() == 16:
                    break
            except Exception:  # noqa: BLE001 - sink not written yet
                pass
    finally:
        q.stop()
    got = spark.read.parquet(out)
    assert got.count() == 16
    assert got.where((F.col("conv_id") == 1) & (F.col("turn") == 7)).first().hist_len == 6


def _history(rows, n=6):
    """Histories of rows in order of (turn, position); equal rows each add one."""
    out, seen = [], {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        seen.setdefault(c, []).append(f"{role}: {text}")
        win = seen[c][-n:]
        out.append((c, t, len(win), "\n".join(win)))
    return sorted(out, key=repr)


def test_history_of_repeated_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 1, "user", "b"), (1, 2, "user", "c")]
    d = _tmp(spark, "conv-repeated")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(d)
    got = sorted((r.turn, r.hist_len) for r in spark.read.parquet(ST.history_stream(spark, d)).collect())
    assert got == [(0, 1), (1, 2), (1, 3), (2, 4)]


def test_history_blocks_hot_conversation_repeated_rows_restart(spark):
    from kbweave.config import Params
    rows = [(7, t, "user", f"m{t}") for t in range(150)] + [(c, t, "user", f"x{t}") for c in (1, 2, None) for t in range(9)]
    rows += [(1, 3, "user", "x3"), (None, 8, "user", "x8")]
    d, out, ckpt = _tmp(spark, "conv-hot"), _tmp(spark, "hb-out"), _tmp(spark, "hb-ckpt")
    first = [r for r in rows if r[1] < 5 or (r[0] == 7 and r[1] < 60)]
    rest = [r for r in rows if r not in first]
    schema = "conv_id long, turn long, role string, text string"
    p = Params(lookback_block_rows=20)
    spark.createDataFrame(first, schema).repartition(3).write.parquet(d)
    ST.history_blocks_stream(spark, d, p, out=out, ckpt=ckpt)
    spark.createDataFrame(rest, schema).repartition(2).write.mode("append").parquet(d)
    ST.history_blocks_stream(spark, d, p, out=out, ckpt=ckpt)          # goes on after a restart
    ST.history_blocks_stream(spark, d, p, out=out, ckpt=ckpt)          # and has nothing left to do
    got = sorted(((r.conv_id, r.turn, r.hist_len, r.history) for r in spark.read.parquet(out).collect()), key=repr)
    assert got == _history(rows)


def test_live_kb_and_maintained_winners(spark):
    from pyspark.sql import types as T
    from kbweave.operators import retrieve as R
    kb, qs, out, ckpt = (_tmp(spark, x) for x in ("live-kb", "live-q", "live-out", "live-ckpt"))
    vec = "doc_id string, embedding array<float>"
    from kbweave.operators.hashing import hashed_vectors
    def rows(texts):
        return spark.createDataFrame([(t, v.tolist()) for t, v in zip(texts, hashed_vectors(256)(texts))], vec)
    rows(["red apples", "blue sky"]).write.parquet(kb)
    qt = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
    def ask(n):
        spark.createDataFrame([(n, "green pears")], qt).write.mode("append").parquet(qs)
        ST.topk_stream(spark, qs, qt, lambda: spark.read.parquet(kb), "item_id", out=out, ckpt=ckpt)
    ask(1)
    rows(["green pears and more"]).write.mode("append").parquet(kb)    # between two micro-batches
    ask(2)
    best = {r.query_id: r.doc_id for r in spark.read.parquet(out).where("rank = 1").collect()}
    assert best[2] == "green pears and more" and best[1] != best[2]
    # Standing queries: the table's files one by one, then all at once.
    queries = rows(["green pears", "apples", "nothing like it"]).withColumnRenamed("doc_id", "query_id")
    schema = spark.read.parquet(kb).schema
    o = ST.topk_maintained_stream(spark, kb, schema, queries, dim=256, k=2, files_per_trigger=1)
    got = sorted(tuple(r) for r in ST.latest_epoch(spark, o).select("query_id", "rank", "doc_id").collect())
    want = R.topk_batch(spark.read.parquet(kb), queries, 2, dim=256).select("query_id", "rank", "doc_id")
    assert got == sorted(tuple(r) for r in want.collect())


def test_rejected_pages_leave_a_record_in_batch_and_stream(spark):
    from kbweave.plans import jobs as J
    from kbweave.schemas import PAGES
    root = _tmp(spark, "rejected")
    pages = spark.createDataFrame([(1, "http://a/1", "<title>ok</title><p>x"), (2, "http://a/2", None), (3, "http://a/3", "<title>bad</title>y"),
                                   (4, "http://a/4", "<title>wide</title>z")], PAGES)

    def embed(texts):
        if "bad" in texts:
            raise RuntimeError("down")
        return [[1.0] * (257 if t == "wide" else 256) for t in texts]
    status = J.ingest(spark, pages, f"{root}/kb", embed=embed, out=f"{root}/out")
    want = {2: "null_title", 3: "embedding_failed", 4: "wrong_dimension"}
    assert status == {"ok": 1, "null_title": 1, "embedding_failed": 1, "wrong_dimension": 1}
    assert {r.page_id: r.reason for r in spark.read.parquet(f"{root}/out/rejected").collect()} == want
    assert spark.read.json(f"{root}/out/entries").count() == 1
    assert {r.page_id for r in spark.read.parquet(f"{root}/kb").collect()} == {1}
    pages.write.parquet(f"{root}/pages")
    ST.ingest_kb_stream(spark, f"{root}/pages", f"{root}/skb", f"{root}/ckpt", embed=embed, rejected=f"{root}/srej")
    assert {r.page_id: r.reason for r in spark.read.parquet(f"{root}/srej").collect()} == want
    assert {r.page_id for r in spark.read.parquet(f"{root}/skb").collect()} == {1}


def test_committed_batches(spark):
    from kbweave.operators.kb import kb_rows
    from kbweave.schemas import ENTRY
    from kbweave.sources import kb_store as KS
    schema = f"page_id long, entry {ENTRY.simpleString()}"
    def rows(*pages):
        return kb_rows(spark.createDataFrame([(p, (t, "c", [])) for p, t in pages], schema), 8)
    p = _tmp(spark, "batches")
    assert KS.read_kb(spark, p).count() == 0
    assert KS.append_batch(rows((1, "one"), (2, "two")), p, "a")
    assert not KS.append_batch(rows((1, "again")), p, "a")                # a retried job stores nothing
    KS.write_data(rows((1, "half")), p, "b")                                # died before its commit
    assert KS.read_kb(spark, p).count() == 4
    assert KS.append_batch(rows((1, "new")), p, "b")
    assert sorted(r.text for r in KS.latest(KS.read_kb(spark, p)).where("ord = 0").collect()) == ["new", "two"]
    assert sorted((r.batch, r.seq, r.rows) for r in KS.commits(spark, p).collect()) == [("a", 1, 4), ("b", 2, 2)]
    with pytest.raises(ValueError):
        KS.append_batch(rows((1, "x")), p, "../x")


def test_stored_vectors_call_the_embedder_once_a_text(spark):
    from kbweave.operators import vector_store as VS
    from kbweave.schemas import ENTRY
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        if "down" in texts:
            raise RuntimeError("down")
        return [[float(len(t)), 1.0, 0.0][: 3 if t == "wide" else 2] for t in texts]
    e = spark.createDataFrame([(1, ("t", "same", [("same", "u"), ("same", "v")])), (2, ("t2", "same", [])), (3, (None, "c", [])),
                               (4, ("down", "same", [])), (5, ("wide", "same", []))], f"page_id long, entry {ENTRY.simpleString()}")
    p = _tmp(spark, "vectors")
    first = {r.page_id: (r.reason, r.vectors) for r in VS.judged_by_store(e, p, 2, embed).collect()}
    assert first[1] == (None, [[1.0, 1.0], [4.0, 1.0], [4.0, 1.0], [4.0, 1.0]]) and first[2][0] is None
    assert [first[i][0] for i in (3, 4, 5)] == ["null_title", "embedding_failed", "wrong_dimension"]
    assert sorted(r.embedding[0] for r in VS.read_store(spark, p).collect()) == [1.0, 2.0, 4.0]
    before = calls.value
    VS.judged_by_store(e.where("page_id < 3"), p, 2, embed).collect()
    assert calls.value == before                                            # nothing is embedded again


def test_streams_read_a_table_of_several_files(spark, tmp_path):
    """A folder whose name ends with .parquet is a table; the file beside it is none of its own."""
    conv = spark.createDataFrame([(c, t, "user", f"m{c}.{t}") for c in range(4) for t in range(3)],
                                 "conv_id long, turn long, role string, text string")
    conv.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    out = ST.history_stream(spark, str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.turn): r.history for r in spark.read.parquet(out).collect()}
    assert len(got) == 12 and got[(2, 1)] == "user: m2.0\nuser: m2.1"
