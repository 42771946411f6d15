"""End-to-end jobs over table paths (what the reference's menu does, as
batch jobs): ingest pages into the knowledge base, and answer messages.

    python -m kbweave.plans.jobs ingest  (--pages P | --markdown M) --kb KB [--model module:function] [--replies R] [--out O] [--dedup] [--batch B] [--vectors V]
    python -m kbweave.plans.jobs answer  --conversations C --kb KB --out O [--generating]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbweave.config import Params, get_session
from kbweave.functions.text import fingerprint
from kbweave.operators import entries as EN
from kbweave.operators import extract as X
from kbweave.operators import kb as K
from kbweave.operators import vector_store as VS
from kbweave.operators.hashing import hashed_vectors
from kbweave.operators.model import structure_pages
from kbweave.operators.partitioning import saved, spread
from kbweave.plans import answer as A
from kbweave.sources import files as FS
from kbweave.sources import kb_store as KS


class Counts(dict):
    """Counts by status; ``rejected`` holds those of parsed entries that are not stored."""
    rejected: dict


def ingest(spark: SparkSession, pages: DataFrame, kb_path: str, replies: DataFrame | None = None,
           dedup: bool = False, model=None, embed=None, out: str | None = None, params: Params = Params(),
           sleep=None, batch: str | None = None, vector_store: str | None = None) -> Counts:
    """pages -> entries -> embedded KB rows appended at ``kb_path``.

    Without ``replies`` and ``model`` entries come from deterministic extraction.
    With a model's JSON ``replies`` (``page_id, reply``), or a ``model`` callable
    on the pages' markdown, they go through cleaning, strict parsing, validation
    and quarantine. An entry with any bad part is rejected whole. ``out`` also
    gets the markdown, the stored entries (JSON), the quarantine of replies that do not
    parse and the rejected entries with the reason of each.

    With ``batch`` the rows are a committed batch of a ``sources.kb_store`` at
    ``kb_path``: the same batch ingested again stores nothing. ``vector_store`` names
    a table of embeddings by content; only texts that it does not hold are embedded.

    Returns the counts by parse status (of stored entries and reasons, without a reply
    to parse); ``.rejected`` has the reasons of the entries that are not stored."""
    pages = spread(pages, params.scan_partitions)
    status, bad = {}, None
    if replies is None and model is None:
        entries = K.entries_struct(X.page_entries(pages))
    else:
        if replies is None:
            replies = _structured(X.page_markdown(pages), model, sleep)
        entries, bad, status = _read_replies(replies)
    if out:
        FS.write_markdown(X.source_keys(pages, params).select("page_id", "page_key").join(
            X.page_markdown(pages), "page_id").select(F.col("page_key").alias("source_key"), "md"), f"{out}/markdown")
    return _store(entries, bad, status, kb_path, dedup, embed, out, params, batch, vector_store)


def ingest_markdown(spark: SparkSession, path: str, kb_path: str, dedup: bool = False, model=None, embed=None,
                    out: str | None = None, params: Params = Params(), sleep=None, batch: str | None = None,
                    vector_store: str | None = None) -> Counts:
    """As ``ingest``, of the markdown files in ``path``: one entry per file, by ``model`` or
    by ``extract.markdown_entries``. A file's page id is a hash of its path."""
    files = FS.read_text_files(spark, path).select(F.xxhash64("path").alias("page_id"), "md")
    if model is None:
        return _store(K.entries_struct(X.markdown_entries(files)), None, {}, kb_path, dedup, embed, out, params, batch, vector_store)
    entries, bad, status = _read_replies(_structured(files, model, sleep))
    return _store(entries, bad, status, kb_path, dedup, embed, out, params, batch, vector_store)


def _structured(md: DataFrame, model, sleep) -> DataFrame:
    import time
    return structure_pages(md, model, sleep=sleep or time.sleep)


def _read_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    parsed = saved(EN.parse_replies(replies), "parsed")             # parsed once; three readers
    entries, bad = EN.split_quarantine(parsed)
    return entries, bad, {r["status"]: r["n"] for r in EN.batch_status(parsed).collect()}


def _store(entries: DataFrame, bad: DataFrame | None, status: dict, kb_path: str, dedup: bool, embed, out: str | None,
           params: Params, batch: str | None, vector_store: str | None) -> Counts:
    """Judge entries, append the rows of those that are stored, record the others."""
    entries = entries.select("page_id", "entry")
    if vector_store is None:
        judged = K.judged(entries, params.text_dim, embed)
    else:
        judged = VS.judged_by_store(entries, vector_store, params.text_dim, embed or hashed_vectors(params.text_dim))
    judged = saved(judged, "judged")                                # judged once; rows, entries and rejections below
    reasons = {r["reason"]: r["count"] for r in judged.groupBy("reason").count().collect()}
    stored = reasons.pop(None, 0)
    status = Counts(status if bad is not None else {"ok": stored, **reasons})
    status.rejected = reasons
    rows = K.stored_rows(judged)
    if batch is None:
        FS.append_kb(rows, kb_path, dedup=dedup)
    else:
        KS.append_batch(rows, kb_path, batch)
    if out:
        FS.write_entries_json(judged.where(F.col("reason").isNull()).select("entry.*").withColumn(
            "fingerprint", fingerprint("content")), f"{out}/entries")
        K.rejected(judged).write.mode("append").parquet(f"{out}/rejected")
        if bad is not None:
            bad.write.mode("append").parquet(f"{out}/quarantine")
    return status


def answer(spark: SparkSession, conversations: DataFrame, kb: DataFrame, out_path: str,
           params: Params = Params(), generating: bool = False) -> None:
    """Answers for every user message, written as a parquet table."""
    if generating:
        res = A.generated_dialog(conversations, kb, params)
    else:
        res = A.answer_messages(conversations, kb, params).drop("hits", "history")
    res.write.mode("overwrite").parquet(out_path)


def _callable(name: str | None):
    """The function that ``module:function`` names."""
    import importlib
    if name is None:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="kbweave")
    sub = ap.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("ingest")
    source = a.add_mutually_exclusive_group(required=True)
    source.add_argument("--pages", help="page table")
    source.add_argument("--markdown", help="folder of markdown files")
    a.add_argument("--model", help="module:function, list of texts to list of JSON replies")
    a.add_argument("--kb", required=True)
    a.add_argument("--replies")
    a.add_argument("--out")
    a.add_argument("--dedup", action="store_true")
    a.add_argument("--batch", help="store as a committed batch of this name, once")
    a.add_argument("--vectors", help="table of embeddings by content")
    b = sub.add_parser("answer")
    b.add_argument("--conversations", required=True)
    b.add_argument("--kb", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--generating", action="store_true")
    b.add_argument("--top-k", type=int, default=Params().top_k)
    ns = ap.parse_args(argv)
    spark = get_session()
    if ns.cmd == "ingest":
        options = {"out": ns.out, "batch": ns.batch, "vector_store": ns.vectors, "dedup": ns.dedup, "model": _callable(ns.model)}
        if ns.markdown:
            print(ingest_markdown(spark, ns.markdown, ns.kb, **options))
        else:
            replies = spark.read.parquet(ns.replies) if ns.replies else None
            print(ingest(spark, spark.read.parquet(ns.pages), ns.kb, replies, **options))
    else:
        answer(spark, spark.read.parquet(ns.conversations), spark.read.parquet(ns.kb), ns.out,
               Params(top_k=ns.top_k), ns.generating)


if __name__ == "__main__":
    main()
