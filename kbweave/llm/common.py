"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kbweave.config import scratch_path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: lineage is cut and an executor lost later costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(taken, stem: str) -> str:
    """A column name with this stem that is not among ``taken`` (compared without case)."""
    low, name = {c.lower() for c in taken}, f"_{stem}"
    while name.lower() in low:
        name += "_"
    return name


def give_back() -> None:
    """Return freed memory of this worker process to the system (where the C library
    can): workers are used again, and what one stage has freed else stays theirs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shuffle_n(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column as one buffer with row offsets
    (null counts as empty). Rows are ``buf[off[i]:off[i + 1]]``."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if not pa.types.is_binary(arr.type) and not pa.types.is_large_binary(arr.type) else b"")
    big = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64 if big else np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64) \
        if len(arr) else np.zeros(1, np.int64)
    if bufs[2] is None or not len(arr) or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    data = np.frombuffer(bufs[2], np.uint8)[off[0]:off[-1]]
    return data, off - off[0]
