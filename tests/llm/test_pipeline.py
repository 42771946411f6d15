"""The pipeline's stages, each against what it must keep of its own input."""

import os
import re

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from kbweave.llm.queries import MODEL
from kbweave.sources.tables import load_table
from test_linedup import brute as brute_lines
from test_simhash import brute as brute_groups

SF = os.environ.get("PIPELINE_SF", "/root/testdata/sf0.001")


def plain(t):
    return " ".join(re.findall(r"[^\W_]+", t.lower()))


def test_stages(spark, tmp_path):
    docs = load_table(spark, SF, "documents")
    columns, out = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out.append({r["doc_id"]: r for r in docs.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    source = {r["doc_id"]: r for r in load_table(spark, SF, "documents").collect()}
    scored, lines, groups, clean, ids = out

    good = [r["doc_id"] for r in load_table(spark, SF, "labels").where((F.col("quality") == 1) & (F.col("toxic") == 0)).collect()]
    assert sum(d in scored for d in good) >= 0.95 * len(good)
    assert all(scored[d] == source[d] for d in scored) and len(scored) < len(source)

    want = brute_lines([(d, r["text"]) for d, r in scored.items()], 1, 50)
    assert {d: r["text"] for d, r in lines.items()} == {d: want[d, r["text"]][0] for d, r in scored.items()}
    assert all(r["n_chars"] == len(r["text"]) for d, r in lines.items() if r["text"] != scored[d]["text"])

    first = {row[0][0] for row in brute_groups([(d, r["text"]) for d, r in lines.items()]) if row[0][0] == row[0][2]}
    assert set(groups) == first

    items = [plain(r["text"]) for r in load_table(spark, SF, "benchmark").collect()]
    holds = {d for d, r in groups.items() if any(i in plain(r["text"]) for i in items)}
    assert not holds & set(clean) and len(set(groups) - set(clean)) <= len(holds) + 1

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert set(ids) == set(clean)
    assert all(list(r["ids"]) == sp.encode(clean[d]["text"]) and r["round_trip"] for d, r in ids.items())


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "ids", "n_tokens", "lang", "source", "n_chars"} <= set(got.columns) and got.count() > 0


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, and columns named like inner ones go through all stages."""
    some = load_table(spark, SF, "documents").where("doc_id < 60")
    long = " ".join(r["text"] for r in some.where("lang = 'en'").collect())[:200_000]
    odd = [(1001, None, "en", "s", None), (1002, "", "en", None, 0), (None, "A null id has a text as well, and it is long enough to be judged.", "en", "s", 5),
           (1003, None, None, None, None), (1004, long, "en", "s", len(long)), (1005, "short", None, "s", 5)]
    docs = some.union(spark.createDataFrame(odd, some.schema)).union(some.where("doc_id = 7"))
    docs = docs.withColumn("_new", F.lit("n")).withColumn("id", F.lit(1)).withColumn("h", F.lit(2)).withColumn("_text", F.lit("t"))
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns, name
        assert after.count() <= n and {r["_new"] for r in after.select("_new").collect()} <= {"n"}, name
        docs, n = after, after.count()
    assert n > 0 and all(r["n_tokens"] == len(r["ids"]) for r in docs.collect())


def test_empty_table(spark, tmp_path):
    docs = load_table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
