"""A knowledge base that takes each batch once, and the latest version of a page.

    <path>/data/batch=<id>/   rows of a batch
    <path>/commits/<id>/      one row, written after the data: the batch counts

A batch that is written again replaces its unfinished first attempt; one that is
committed already is left alone. Readers take committed batches only, so a job that
dies between its writes, or runs twice, stores nothing twice and shows nothing half.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbweave.schemas import KB_DOCUMENT
from kbweave.sources.files import assert_schema, path_exists

COMMIT = T.StructType([T.StructField("batch", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("rows", T.LongType())])


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``(batch, seq, rows)`` of every committed batch; ``seq`` is their order."""
    path = path.rstrip("/")
    if not path_exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).option("recursiveFileLookup", "true").parquet(f"{path}/commits")


def append_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Store ``df`` as ``batch`` (letters, digits, ``-`` and ``_``) unless it is
    committed; true if it was stored. One writer at a time."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
        raise ValueError("a batch is named by letters, digits, - and _")
    spark, path = df.sparkSession, path.rstrip("/")
    done = commits(spark, path)
    if not done.where(F.col("batch") == batch).isEmpty():
        return False
    write_data(df, path, batch)
    rows = spark.read.schema(KB_DOCUMENT).parquet(f"{path}/data/batch={batch}").count()
    seq = (done.agg(F.max("seq")).first()[0] or 0) + 1
    spark.createDataFrame([(batch, seq, rows)], COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{batch}")
    return True


def write_data(df: DataFrame, path: str, batch: str) -> None:
    """A batch's rows, in place of what an unfinished attempt left."""
    assert_schema(df).write.mode("overwrite").parquet(f"{path.rstrip('/')}/data/batch={batch}")


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all committed batches, with ``batch`` and ``seq``."""
    path = path.rstrip("/")
    done = commits(spark, path)
    if done.isEmpty():
        return spark.createDataFrame([], T.StructType([*KB_DOCUMENT.fields, T.StructField("batch", T.StringType()), T.StructField("seq", T.LongType())]))
    rows = spark.read.schema(T.StructType([*KB_DOCUMENT.fields, T.StructField("batch", T.StringType())])).parquet(f"{path}/data")
    # One short row a batch: the join prunes the folders of batches that never were committed.
    return rows.join(done.select("batch", "seq"), "batch").select(*KB_DOCUMENT.names, "batch", "seq")


def latest(kb: DataFrame) -> DataFrame:
    """Of every page the rows of the last batch that holds it. The last batch of each
    page is a partial aggregate, so a page with very many rows is no hot key."""
    last = kb.groupBy("page_id").agg(F.max("seq").alias("seq"))
    a, b = kb.alias("a"), last.alias("b")
    same = F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.seq") == F.col("b.seq"))
    return a.join(b, same, "left_semi").drop("batch", "seq")
