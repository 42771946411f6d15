"""Structured entries: model reply cleaning, strict JSON parsing, required-field
validation, quarantine and batch status counts. All row-local expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbweave.functions import strictjson as J
from kbweave.functions.strictjson import FENCE
from kbweave.operators.hashing import sliced
from kbweave.schemas import ENTRY


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_fence(s) -> Column:
    """Only a reply that starts with a fence is cleaned: every line starting
    with a fence is dropped and the rest re-joined with newlines."""
    s = _c(s)
    kept = F.filter(F.split(s, "\n"), lambda l: ~l.startswith(FENCE))
    return F.when(s.startswith(FENCE), F.array_join(kept, "\n")).otherwise(s)


REPLY = T.StructType([T.StructField("status", T.StringType()), T.StructField("entry", ENTRY)])


@F.arrow_udf(REPLY)
def _parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("status", pa.string()), ("entry", pa.struct([
        ("title", pa.string()), ("content", pa.string()),
        ("links", pa.list_(pa.struct([("text", pa.string()), ("url", pa.string())])))]))])
    for col in sliced(batches):
        out = []
        for s in col.to_pylist():
            status, value = ("bad_json", None) if s is None else J.read(s)
            out.append({"status": status, "entry": J.entry(value) if status == "ok" else None})
        yield pa.array(out, kind)


def entry_status(s) -> Column:
    """ok, bad_json, not_object or missing_fields (see ``functions.strictjson``); null is bad_json."""
    return _parsed(_c(s))["status"]


def has_fields(s) -> Column:
    """Key presence only (a null value passes); the value must be an object."""
    return entry_status(s) == "ok"


def parse_replies(df: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Adds ``json`` (cleaned), ``status`` and the parsed ``entry`` struct."""
    named = df.withColumn("json", clean_fence(reply_col)).withColumn("_p", _parsed("json"))
    return named.select(*[c for c in named.columns if c not in ("_p", "status", "entry")], F.col("_p.status").alias("status"),
                        F.col("_p.entry").alias("entry"))


def split_quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good entries and the quarantine (every failure kept with its reason)."""
    from kbweave.operators.partitioning import gate
    good = gate(parsed, F.col("status") == "ok")
    bad = gate(parsed, F.col("status") != "ok")
    return good, bad


def batch_status(parsed: DataFrame) -> DataFrame:
    """Success / failure counts plus the total, one row per status."""
    from pyspark.sql import Window
    counts = parsed.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    # The window runs over the handful of status rows only.
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy()))


def damaged_replies(entries: DataFrame, key: str = "page_id") -> DataFrame:
    """Model-style JSON replies built from extracted entries, with fixed,
    id-driven damage so every failure path is exercised on real rows:
    %13 first link loses its url, %17 null title, %7 no ``links`` key,
    %11 truncated to half, %5 wrapped in a code fence. Every row is kept."""
    k = F.col(key)
    opts = {"ignoreNullFields": "false"}
    # Staged projections: each stage refers to the previous one by name, so
    # the expression tree never duplicates the extraction underneath.
    r = entries.select(
        key,
        F.when(k % 17 == 0, F.lit(None).cast("string")).otherwise(F.col("title")).alias("_title"),
        F.col("content").alias("_content"),
        F.transform("links", lambda l, i: F.struct(
            l["text"].alias("text"),
            F.when((k % 13 == 0) & (i == 0), F.lit(None).cast("string")).otherwise(l["url"]).alias("url"))
        ).alias("_links"))
    r = r.select(key, F.when(k % 7 == 0, F.to_json(F.struct(F.col("_title").alias("title"),
                                                           F.col("_content").alias("content")), opts))
                 .otherwise(F.to_json(F.struct(F.col("_title").alias("title"), F.col("_content").alias("content"),
                                               F.col("_links").alias("links")), opts)).alias("_j"))
    r = r.select(key, F.when(k % 11 == 0, F.substring("_j", 1, F.floor(F.length("_j") / 2).cast("int")))
                 .otherwise(F.col("_j")).alias("_j"))
    return r.select(key, F.when(k % 5 == 0, F.concat(F.lit(FENCE + "json\n"), F.col("_j"), F.lit("\n" + FENCE)))
                    .otherwise(F.col("_j")).alias("reply"))
