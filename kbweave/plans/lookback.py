"""Skew-safe bounded look-back ("the previous n rows of the same key").

A window ``partitionBy(key).orderBy(o).rowsBetween(-(n-1), 0)`` sends every
row of a key to one task; one conversation holding a third of all messages
would then be one task. Instead:

1. range-partition and sort by ``(key, order)``; a hot key is spread over
   many range partitions;
2. write that sorted table once to the shared checkpoint folder (lineage
   cut, stable row ids that survive executor loss and retries);
3. turn the row ids into a dense global index ``g`` from per-partition
   counts (one small row per partition, broadcast by construction);
4. cut ``g`` into fixed blocks of ``block_rows`` rows and copy each row into
   the blocks of the ``n-1`` rows after it (the halo); the window then
   partitions by block, so no task sees more than ``block_rows + n - 1`` rows,
   whatever the key distribution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbweave.config import scratch_path
from kbweave.operators.partitioning import gate

_LOW33 = (1 << 33) - 1


def global_index(df: DataFrame, key: str, order: str, block_rows: int, num_partitions: int | None = None) -> DataFrame:
    """Adds ``_g``: the dense 0-based rank of each row under (key, order). The
    number of range partitions follows the input unless it is given."""
    spark = df.sparkSession
    n = num_partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // block_rows))
    path = scratch_path(spark, "lookback")
    (df.repartitionByRange(n, key, order).sortWithinPartitions(key, order)
       .withColumn("_mid", F.monotonically_increasing_id())
       .write.mode("overwrite").parquet(path))
    s = spark.read.parquet(path)
    s = s.withColumn("_pid", F.shiftright("_mid", 33))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per range partition: the global window below is tiny.
    offs = counts.select("_pid", F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    return (s.join(F.broadcast(offs), "_pid")
             .withColumn("_g", F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW33)))
             .drop("_pid", "_mid", "_off"))


def lookback(df: DataFrame, key: str, order: str, frames: dict[str, int], payload: list[str],
             block_rows: int = 1_000_000) -> DataFrame:
    """For each row, ``frames[name]`` = list of the last n rows of its key
    (itself included, oldest first) as structs of ``[order] + payload``. A null
    key is a key like any other. Output: input columns + frames."""
    s = global_index(df, key, order, block_rows)
    halo = max(frames.values()) - 1
    blk = F.floor(F.col("_g") / F.lit(block_rows)).cast("long")
    # One scan: a row goes to its own block and, as halo, to every later block
    # that holds one of the ``halo`` rows after it.
    last = F.floor((F.col("_g") + F.lit(halo)) / F.lit(block_rows)).cast("long")
    targets = F.transform(F.sequence(blk, last), lambda b: F.struct(b.alias("_blk"), (b > blk).alias("_halo")))
    base = s.select("*", F.inline(targets))
    w = Window.partitionBy("_blk").orderBy("_g")
    item = F.struct(F.col(key).alias("_k"), *[F.col(c) for c in [order] + payload])
    out = base
    for name, n in frames.items():
        lst = F.collect_list(item).over(w.rowsBetween(-(n - 1), 0))
        out = out.withColumn(name, lst)
    out = gate(out, ~F.col("_halo"))
    for name in frames:
        out = out.withColumn(name, F.transform(F.filter(name, lambda m: m["_k"].eqNullSafe(F.col(key))),
                                               lambda m: m.dropFields("_k")))
    return out.drop("_blk", "_halo", "_g")


def plain_lookback(df: DataFrame, key: str, order: str, frames: dict[str, int],
                   payload: list[str]) -> DataFrame:
    """The same as a keyed window (one task per key): the tests' reference."""
    w = Window.partitionBy(key).orderBy(order)
    item = F.struct(*[F.col(c) for c in [order] + payload])
    out = df
    for name, n in frames.items():
        out = out.withColumn(name, F.collect_list(item).over(w.rowsBetween(-(n - 1), 0)))
    return out
