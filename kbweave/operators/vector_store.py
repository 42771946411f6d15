"""Embeddings stored by content: a text is embedded once, whoever ingests it again.

The store is a table ``(key, embedding)``; the key is the SHA-256 of the text. An
ingest takes its distinct texts, leaves out those whose key is stored (anti join),
embeds the rest and appends them; then every text finds its vector by its key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbweave.operators.kb import WrongDimension, reject_reason
from kbweave.operators.partitioning import saved
from kbweave.sources.files import path_exists

STORED = T.StructType([T.StructField("key", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
_MADE = T.StructType([*STORED.fields, T.StructField("error", T.StringType())])


def text_key(text) -> "F.Column":
    return F.sha2(F.encode(F.col(text) if isinstance(text, str) else text, "UTF-8"), 256)


def read_store(spark, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], STORED)


def add_texts(texts: DataFrame, path: str, dim: int, embed, text_col: str = "text", batch_size: int = 256) -> DataFrame:
    """Embed the texts that the store does not hold and append them; returns
    ``(key, error)`` of those that could not be embedded (they are not stored and are
    tried again next time). ``embed(list[str]) -> list[vector]``; null texts are left out."""
    spark = texts.sparkSession
    t = texts.where(F.col(text_col).isNotNull()).select(text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    new = t.groupBy("key").agg(F.first("text").alias("text")).join(read_store(spark, path).select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def call(some: list[str]) -> list[list[float]]:
            got = [[float(x) for x in v] for v in embed(some)]
            if len(got) != len(some):
                raise ValueError("the embedder gave another number of vectors")
            return got

        def alone(text: str):
            try:
                v = call([text])[0]
                if len(v) != dim:
                    raise WrongDimension
                return v, None
            except WrongDimension:
                return None, "wrong_dimension"
            except Exception:  # noqa: BLE001 - a failed text costs no other its vector
                return None, "embedding_failed"
        for b in batches:
            for lo in range(0, len(b), batch_size):
                part = b.iloc[lo:lo + batch_size]
                some = part["text"].tolist()
                try:
                    out = [(v, None) for v in call(some)]
                    if any(len(v) != dim for v, _ in out):
                        raise WrongDimension
                except Exception:  # noqa: BLE001
                    out = [alone(x) for x in some]
                yield pd.DataFrame({"key": part["key"].tolist(), "embedding": [v for v, _ in out], "error": [e for _, e in out]})
    made = saved(new.mapInPandas(run, _MADE), "embedded")
    made.where(F.col("error").isNull()).select("key", "embedding").write.mode("append").parquet(path)
    return made.where(F.col("error").isNotNull()).select("key", "error")


def judged_by_store(entries: DataFrame, path: str, dim: int, embed, key: str = "page_id") -> DataFrame:
    """As ``kb.judged`` (``vectors`` and ``reason``), with every text's vector taken from
    the store under ``path``; only texts that are new to it are embedded. Entries are
    numbered by ``key``, which must be distinct."""
    spark = entries.sparkSession
    named = saved(entries.withColumn("reason", reject_reason()), "entries")
    e = F.col("entry")
    texts = F.concat(F.array(e["title"], e["content"]), F.transform(e["links"], lambda x: x["text"]))
    parts = named.where(F.col("reason").isNull()).select(key, F.posexplode(texts).alias("pos", "text")).select(
        key, "pos", text_key("text").alias("key"), "text")
    failed = add_texts(parts, path, dim, embed)
    held = read_store(spark, path).groupBy("key").agg(F.first("embedding").alias("v"))      # a repeated append changes nothing
    found = parts.drop("text").join(held, "key", "left").join(failed, "key", "left")
    vectors = found.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("vs"), F.max("error").alias("error"))
    out = named.join(vectors, key, "left")
    whole = F.when(F.col("error").isNull(), F.transform("vs", lambda x: x["v"]))
    return out.select(*[c for c in named.columns if c != "reason"], whole.alias("vectors"),
                      F.coalesce("reason", "error").alias("reason"))
