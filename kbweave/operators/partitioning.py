"""Small partitioning helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kbweave.config import scratch_path


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Deal rows out over ``partitions`` tasks: for a table whose files are fewer
    than the cores that expensive row-local work should use. None: as it is."""
    return df.repartition(partitions) if partitions else df


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: lineage is
    cut, and an executor lost later costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gate(df: DataFrame, cond) -> DataFrame:
    """Keep rows where ``cond`` holds, without a Filter node.

    A Filter on a column computed by an expensive projection is pushed below
    that projection by the optimizer, which then evaluates the expression in
    both places. Emitting each kept row through a generator keeps the
    condition where it is written, and the projection is evaluated once.
    """
    from pyspark.sql import functions as F
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.inline(F.filter(F.array(row), lambda _r: cond)))
