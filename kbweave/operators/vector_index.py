"""A stored inverted-file index over vectors: approximate and exact top-k.

``build_index`` fits the cell centres on a bounded sample (``vector_blocks.SAMPLE_ROWS``
rows at most), assigns every row to its nearest centre and writes packed blocks
partitioned by cell. A query then reads the blocks of its ``n_probe`` nearest
cells only: recall grows with ``n_probe``, and all cells together are exact, as
is the pruned search, which visits just the cells whose bound reaches the
query's k-th similarity. No candidate of a visited cell is left out.

    <path>/blocks/cell=<c>/   packed blocks
    <path>/centers            one row per cell: its direction
    <path>/stats              per build or append: rows and smallest cosine of each cell
    <path>/about              dimension, number type, id type, rows of a block
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbweave.config import Params
from kbweave.operators import vector_blocks as B
from kbweave.operators.partitioning import saved
from kbweave.operators.retrieve import vector_rows


@dataclass(frozen=True)
class VectorIndex:
    path: str
    dim: int
    kind: str
    block_rows: int
    cells: B.Cells

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/blocks")


def _write(index: VectorIndex, assigned: DataFrame) -> None:
    blocks = B.blocks(assigned, index.cells, index.dim, index.block_rows)
    blocks.write.mode("append").partitionBy("cell").parquet(f"{index.path}/blocks")


def _stats(spark: SparkSession, cells: B.Cells, path: str) -> None:
    rows = [(i, int(n), float(cells.cos[i]) if i < cells.n else 1.0) for i, n in enumerate(cells.rows)]
    spark.createDataFrame(rows, "cell int, n long, cos double").coalesce(1).write.mode("append").parquet(f"{path}/stats")


def build_index(docs: DataFrame, path: str, *, id_col: str = "doc_id", vec_col: str = "embedding", dim: int,
                cells: int | None = None, block_rows: int | None = None, seed: int = 0,
                params: Params = Params()) -> VectorIndex:
    """Index every row of ``docs`` that has a vector of ``dim`` numbers under
    ``path`` (a new folder). ``cells`` defaults to the square root of the rows, at
    most ``MAX_CELLS``. Zero vectors form a cell of their own."""
    spark = docs.sparkSession
    d = vector_rows(docs, id_col, vec_col, dim)
    rows = d.count()
    kind = B.vector_type(d)
    block = block_rows or max(1, params.block_bytes // (dim * np.dtype(kind).itemsize))
    assigned, made = B.group(d, rows, max(1, cells or int(rows ** 0.5)), dim, seed)
    index = VectorIndex(path.rstrip("/"), dim, kind, block, made)
    _write(index, assigned)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(made.centers)], "cell int, center array<double>") \
        .coalesce(1).write.parquet(f"{index.path}/centers")
    _stats(spark, made, index.path)
    spark.createDataFrame([(dim, kind, block)], "dim int, kind string, block_rows int").write.parquet(f"{index.path}/about")
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """The index stored under ``path``; what comes to the driver is bounded by the number of cells."""
    path = path.rstrip("/")
    about = spark.read.parquet(f"{path}/about").first()
    centers = np.array([r["center"] for r in spark.read.parquet(f"{path}/centers").orderBy("cell").collect()])
    rows, cos = np.zeros(len(centers) + 1, np.int64), np.ones(len(centers))
    for r in spark.read.parquet(f"{path}/stats").groupBy("cell").agg(F.sum("n").alias("n"), F.min("cos").alias("cos")).collect():
        rows[r["cell"]] = r["n"]
        if r["cell"] < len(centers):
            cos[r["cell"]] = r["cos"]
    return VectorIndex(path, about["dim"], about["kind"], about["block_rows"], B.Cells(centers, cos, rows))


def append_index(index: VectorIndex, docs: DataFrame, *, id_col: str = "doc_id", vec_col: str = "embedding") -> VectorIndex:
    """Add rows to the cells of their nearest centres; the centres stay."""
    spark = docs.sparkSession
    d = vector_rows(docs, id_col, vec_col, index.dim)
    if B.vector_type(d) != index.kind:
        raise ValueError("the index holds vectors of another number type")
    assigned = saved(B.assign(d, index.cells.centers, index.dim), "index-append")
    new = B.measured(assigned, index.cells.centers)
    grown = B.Cells(new.centers, np.minimum(new.cos, index.cells.cos), new.rows + index.cells.rows)
    out = VectorIndex(index.path, index.dim, index.kind, index.block_rows, grown)
    _write(out, assigned)
    _stats(spark, new, index.path)
    return out


def _search(index: VectorIndex, queries: DataFrame, k: int | None, query_id: str, query_vec: str,
            n_probe: int | None, exact: bool) -> tuple[DataFrame, DataFrame]:
    """The queries ``(id, vec, qid)`` as they were written once, and their ``(qid, rank, doc_id, similarity, cell)``."""
    k = Params().top_k if k is None else k
    if k < 1 or (n_probe is not None and n_probe < 1):
        raise ValueError("k and n_probe must be 1 or more")
    spark = queries.sparkSession
    q = vector_rows(queries, query_id, query_vec, index.dim)
    q = saved(q.withColumn("qid", F.monotonically_increasing_id()), "queries")
    find = B.search_pruned if exact and n_probe else B.search
    return q, find(index.blocks(spark), q.select("qid", "vec"), index.cells, k, index.dim, index.block_rows, index.kind, n_probe, asked=q.count())


def topk_indexed(index: VectorIndex, queries: DataFrame, k: int | None = None, *, query_id: str = "query_id",
                 query_vec: str = "embedding", n_probe: int | None = None, exact: bool = False) -> DataFrame:
    """``(query_id, rank, doc_id, similarity)`` from the stored index.

    ``n_probe`` nearest cells are searched (None: all, an exact answer). With
    ``exact``, cells beyond them are visited as far as they can hold a better
    document. Queries without a vector of the index's dimension have no answer."""
    q, top = _search(index, queries, k, query_id, query_vec, n_probe, exact)
    # As many rows as queries: merged, not gathered on the driver for a broadcast.
    return top.join(q.select("qid", F.col("id").alias("query_id")).hint("merge"), "qid").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "similarity")


def found_share(got: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``(wanted, found)``: neighbours of the exact answer, and how many of them ``got`` holds."""
    both = exact.select("query_id", "doc_id").join(got.select("query_id", "doc_id", F.lit(1).alias("hit")).hint("merge"), ["query_id", "doc_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))


def probes_needed(index: VectorIndex, queries: DataFrame, found: DataFrame) -> DataFrame:
    """``(probes, n)``: how many of the ``found`` rows ``(qid, cell)`` a search meets from ``probes`` cells on.

    A row is met when its cell is among the query's ``probes`` nearest; cells as near
    as it count as nearer, and the zero vectors' cell comes with all cells only."""
    shared = queries.sparkSession.sparkContext.broadcast(index.cells.centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        step = max(1, B.SCORE_BYTES // (16 * len(c)))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                u, _ = B.unit_rows(B.matrix(b.column(0), index.dim))
                sim = np.c_[u @ c.T, np.full(len(u), -np.inf)]                  # last: the zero vectors' cell
                own = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                need = np.count_nonzero(sim >= sim[np.arange(len(u)), own][:, None], axis=1)
                probes, n = np.unique(np.minimum(need, len(c)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(probes.astype(np.int32)), pa.array(n.astype(np.int64))], ["probes", "n"])
    # As many rows as queries: merged, not gathered on the driver for a broadcast.
    met = found.select("qid", "cell").join(queries.select("qid", "vec").hint("merge"), "qid").select("vec", "cell")
    return met.mapInArrow(run, "probes int, n long").groupBy("probes").agg(F.sum("n").alias("n"))


def choose_probes(index: VectorIndex, queries: DataFrame, k: int | None = None, *, query_id: str = "query_id",
                  query_vec: str = "embedding", recall: float = 0.9) -> int:
    """Smallest power of two of probed cells (or all) that finds ``recall`` of the
    exact neighbours of ``queries`` (a small table of typical ones with distinct ids).

    One exact search tells it: a neighbour is found as soon as its cell is probed."""
    q, exact = _search(index, queries, k, query_id, query_vec, 1, True)
    need = {r["probes"]: r["n"] for r in probes_needed(index, q, exact).collect()}    # at most a row a cell
    wanted, n = sum(need.values()), 1
    while n < index.cells.n:
        if sum(x for probes, x in need.items() if probes <= n) >= recall * wanted:
            return n
        n *= 2
    return index.cells.n
