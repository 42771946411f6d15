"""Shard placement through a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table, given
by an offset and a skip derived from its name. The shards take turns; on its
turn a shard claims the first free slot of its order, until the table is full. A
key goes to the shard that owns slot ``hash(key) mod size``: constant time, each
shard owns nearly the same number of slots, and adding or removing one shard
moves little more than its own share of the keys.

The table's size is a parameter (65,537 by default), so what is broadcast is
bounded whatever the data; shards must be fewer than slots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbweave.llm.common import fresh

TABLE_SIZE = 65537
MAX_TABLE = 1 << 22


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def build_table(shards: Sequence[str] | Mapping[str, int], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> shard index (in sorted name order). A mapping gives each shard
    its weight: the number of turns it has in a round (1 or more)."""
    names = sorted(shards)
    if not _is_prime(size) or size > MAX_TABLE:
        raise ValueError(f"table size must be a prime of at most {MAX_TABLE}")
    if not names or len(set(names)) != len(names) or len(names) >= size:
        raise ValueError("shard names must be distinct, at least one and fewer than slots")
    weight = [int(shards[n]) if isinstance(shards, Mapping) else 1 for n in names]
    if min(weight) < 1:
        raise ValueError("weights must be 1 or more")
    at, skip = [], []
    for n in names:
        d = hashlib.sha256(n.encode("utf-8")).digest()
        at.append(int.from_bytes(d[:8], "big") % size)
        skip.append(int.from_bytes(d[8:16], "big") % (size - 1) + 1)
    table, left = [-1] * size, size
    while True:
        for i, w in enumerate(weight):
            for _ in range(w):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % size
                table[at[i]] = i
                left -= 1
                if not left:
                    return table


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: XXH64 (seed 42) modulo the table size."""
    return F.pmod(F.xxhash64(key), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str] | Mapping[str, int], size: int = TABLE_SIZE,
          slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with its slot and shard name; no shuffle, every row kept.

    Equal keys always share a shard; a null key hashes like any value and all
    null keys share one shard. Repeated rows stay, an empty table stays empty,
    and existing columns of the two output names are replaced, whatever the others
    are called."""
    spark = df.sparkSession
    names = sorted(shards)
    own = build_table(shards, size)
    at, to = fresh(df.columns, "slot"), fresh(df.columns, "shard")
    owners = spark.createDataFrame([(i, names[s]) for i, s in enumerate(own)], f"`{at}` int, `{to}` string")
    rest = [F.col(c) for c in df.columns if c not in (slot_col, shard_col)]
    keyed = df.select(*rest, slot(F.col(key), size).alias(at))
    return (keyed.join(F.broadcast(owners), at)
            .select(*rest, F.col(at).alias(slot_col), F.col(to).alias(shard_col)))


def write_shards(df: DataFrame, key: str, shards: Sequence[str] | Mapping[str, int], path: str,
                 size: int = TABLE_SIZE, files_per_shard: int = 8) -> None:
    """Write one folder per shard. Rows are dealt over ``files_per_shard`` files
    by their slot and a row hash, so a shard that a hot key makes large is still
    written by several tasks."""
    placed = place(df, key, shards, size, "_s", "shard")
    salt = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in df.columns]), F.lit(files_per_shard))
    n = min(len(shards) * files_per_shard, 100_000)
    placed.drop("_s").repartition(n, F.col("shard"), salt).write.partitionBy("shard").parquet(path)
