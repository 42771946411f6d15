"""Knowledge-base construction: entries -> typed document rows, entry
atomicity, dimension constraint and hashed term-frequency embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbweave.functions.text import tokens
from kbweave.operators.hashing import sliced

ORD_DIGITS = 10   # digits of ``ord`` in a document id (ord 0 title, 1 content, 2.. links)


def reject_reason(entry: str = "entry") -> Column:
    """Why an entry cannot be stored: ``null_title``, ``null_content``, ``null_links``,
    ``link_without_text`` or ``link_without_url`` (the first that holds), null if it
    can. Atomicity: one bad part rejects the whole entry, decided on the entry row
    itself, before it is expanded, so no window or shuffle is needed."""
    e = F.col(entry)
    none = F.lit(False)
    return (F.when(e["title"].isNull(), "null_title").when(e["content"].isNull(), "null_content")
            .when(e["links"].isNull(), "null_links")
            .when(F.coalesce(F.exists(e["links"], lambda x: x["text"].isNull()), none), "link_without_text")
            .when(F.coalesce(F.exists(e["links"], lambda x: x["url"].isNull()), none), "link_without_url"))


def entry_ok(entry: str = "entry") -> Column:
    return reject_reason(entry).isNull()


def expand_entries(df: DataFrame, key: str = "page_id", entry: str = "entry", vectors: str | None = None) -> DataFrame:
    """One row per title, content and link (one explode of a per-row array).
    ``vectors`` names the entry's embeddings in the same order, if it has them."""
    e = F.col(entry)
    parts = F.concat(
        F.array(F.struct(F.lit(0).alias("ord"), F.lit("title").alias("doc_type"),
                         e["title"].alias("text"), F.lit("").alias("url"))),
        F.array(F.struct(F.lit(1).alias("ord"), F.lit("content").alias("doc_type"),
                         e["content"].alias("text"), F.lit("").alias("url"))),
        F.transform(F.coalesce(e["links"], F.array().cast("array<struct<text:string,url:string>>")),
                    lambda l, i: F.struct((i + 2).alias("ord"), F.lit("link").alias("doc_type"),
                                          l["text"].alias("text"), l["url"].alias("url"))))
    cols = ["ord", "doc_type", "text", "url"]
    if vectors:
        parts = F.zip_with(parts, vectors, lambda p, v: F.struct(*[p[c].alias(c) for c in cols], v.alias("embedding")))
        cols = cols + ["embedding"]
    doc_id = F.concat(F.col(key).cast("string"), F.lit(":"), F.lpad(F.col("ord").cast("string"), ORD_DIGITS, "0"))
    return df.select(key, F.inline(parts)).select(doc_id.alias("doc_id"), key, *cols)


class WrongDimension(ValueError):
    """An embedder's vector has another length than the table's."""


VECTORS = T.StructType([T.StructField("vectors", T.ArrayType(T.ArrayType(T.FloatType()))), T.StructField("error", T.StringType())])


def embed_entries(df: DataFrame, dim: int, fn=None, entry: str = "entry", batch_size: int = 256) -> DataFrame:
    """Adds ``vectors``, one embedding per title, content and link of an entry, and
    ``vector_error``. Entries that cannot be stored anyway are not embedded.

    ``fn(list[str]) -> list[vector]`` is called with at most ``batch_size`` texts;
    the default hashes term frequencies. An entry any of whose texts cannot be
    embedded (``embedding_failed``), or whose vectors have another dimension than
    ``dim`` (``wrong_dimension``), has null vectors and is to be rejected whole: when a
    call fails, its entries are tried one by one."""
    e = F.col(entry)
    texts = F.when(entry_ok(entry), F.concat(F.array(e["title"], e["content"]), F.transform(e["links"], lambda x: x["text"])))
    if fn is None:
        from kbweave.operators.hashing import dense_texts_udf
        return df.withColumn("vectors", dense_texts_udf(dim)(texts)).withColumn("vector_error", F.lit(None).cast("string"))

    @F.arrow_udf(VECTORS)
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def call(some: list[str]):
            out = []
            for i in range(0, len(some), batch_size):
                part = some[i:i + batch_size]
                got = [[float(x) for x in v] for v in fn(part)]
                if len(got) != len(part):
                    raise ValueError("the embedder gave another number of vectors")
                if any(len(v) != dim for v in got):
                    raise WrongDimension
                out += got
            return out

        def alone(entry_texts):
            try:
                return call(list(entry_texts)), None
            except WrongDimension:
                return None, "wrong_dimension"
            except Exception:  # noqa: BLE001 - a failed embedding rejects its entry
                return None, "embedding_failed"
        for col in sliced(batches):
            rows = col.to_pylist()
            try:
                vecs = iter(call([t for v in rows if v is not None for t in v]))
                out = [(None if v is None else [next(vecs) for _ in v], None) for v in rows]
            except Exception:  # noqa: BLE001
                out = [(None, None) if v is None else alone(v) for v in rows]
            yield pa.StructArray.from_arrays([pa.array([v for v, _ in out], pa.list_(pa.list_(pa.float32()))),
                                              pa.array([e for _, e in out], pa.string())], ["vectors", "error"])
    got = df.withColumn("_v", embed(texts))
    return got.withColumn("vectors", F.col("_v.vectors")).withColumn("vector_error", F.col("_v.error")).drop("_v")


def judged(entries: DataFrame, dim: int, embed=None) -> DataFrame:
    """Entries with ``vectors`` and ``reason`` (null: to be stored). Write it once, then
    take ``stored_rows`` and ``rejected`` from it."""
    out = embed_entries(entries, dim, embed).withColumn("reason", F.coalesce(reject_reason(), F.col("vector_error")))
    return out.drop("vector_error")


def stored_rows(judged_entries: DataFrame) -> DataFrame:
    """Knowledge-base rows of the entries without a reason against them."""
    from kbweave.operators.partitioning import gate
    return expand_entries(gate(judged_entries, F.col("reason").isNull()), vectors="vectors")


def rejected(judged_entries: DataFrame, key: str = "page_id") -> DataFrame:
    """``(key, reason, entry)`` of the entries that are not stored."""
    return judged_entries.where(F.col("reason").isNotNull()).select(key, "reason", "entry")


def kb_rows(entries: DataFrame, dim: int, embed=None) -> DataFrame:
    """Entries -> stored rows with embeddings; an entry with any bad part or any
    text that cannot be embedded is rejected whole."""
    return stored_rows(judged(entries, dim, embed))


def entries_struct(df: DataFrame) -> DataFrame:
    return df.withColumn("entry", F.struct("title", "content", "links"))


def hashed_tf(df: DataFrame, key: str, text_col: str, dim: int) -> DataFrame:
    """Sparse hashed term frequencies ``(key, bucket, tf)``. A text's tokens
    all live in its row, so the counts are made inside the row (memoised md5
    buckets + bincount in Arrow batches): a map-only job, no shuffle."""
    from kbweave.operators.hashing import sparse_tf_udf
    tf = sparse_tf_udf(dim)(tokens(text_col))
    return (df.select(key, tf.alias("_tf"))
            .select(key, F.inline(F.arrays_zip(F.col("_tf.bucket").alias("bucket"),
                                               F.col("_tf.tf").alias("tf")))))


def embed_hashed(df: DataFrame, text_col: str, dim: int, out: str = "embedding") -> DataFrame:
    """Default embedder: dense hashed term-frequency vector per text."""
    from kbweave.operators.hashing import dense_tf_udf
    return df.withColumn(out, dense_tf_udf(dim)(tokens(text_col)))
