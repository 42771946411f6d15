"""Exact cosine top-k retrieval.

* ``topk_single`` - one query vector, JVM-only: cosine via higher-order
  functions and ``orderBy(...).limit(k)`` (planned as TakeOrderedAndProject).
* ``topk_batch`` - many queries at once, wholly on the executors: documents in
  packed blocks grouped by direction, queries in packs that visit only the blocks
  that can hold one of their k best (``operators.vector_blocks``). Each pair of
  a part and a pack is one matrix product; a window with ``row_number() <= k`` (planned as
  WindowGroupLimit, partial before the shuffle) merges the parts' winners.

Order rule for every form: similarity descending, NULL (zero vector) last,
ties by ascending document id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbweave.config import Params
from kbweave.functions import vectors as V
from kbweave.functions.text import tokens
from kbweave.operators import vector_blocks as B
from kbweave.operators.partitioning import saved
from kbweave.operators.vector_blocks import SIM_DECIMALS


def topk_single(docs: DataFrame, query_vec, k: int | None = None, *, id_col: str = "doc_id",
                vec_col: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Top-k of one query over all documents. ``query_vec`` is a Python list or
    a Column (e.g. a scalar subquery ``df.select(vec).scalar()``)."""
    k = Params().top_k if k is None else k
    if k < 0:
        raise ValueError("k must be >= 0")
    q = F.array(*[F.lit(float(x)) for x in query_vec]) if isinstance(query_vec, (list, tuple)) else query_vec
    keep = keep or []
    scored = (docs.select(id_col, vec_col, *keep).withColumn("_q", q)
              .select(id_col, *keep, F.round(V.cosine(vec_col, "_q"), SIM_DECIMALS).alias("similarity")))
    order = [F.desc_nulls_last("similarity"), F.asc(id_col)]
    top = scored.orderBy(*order).limit(k)
    # The window ranks the k winners only (a bounded, single-partition step).
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


# ---------------------------------------------------------------- batch form

def vector_rows(df: DataFrame, id_col: str, vec_col: str, dim: int, kind: str = "dense") -> DataFrame:
    """``(id, vec)`` with vectors of ``dim`` numbers. Single precision stays, other
    numbers become double; rows of another length or with a null number are left
    out. ``kind`` ``tokens`` or ``buckets``: lists to be hashed or counted."""
    out = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    if kind != "dense":
        return B.dense(out, dim, kind)
    if "float" not in out.schema["vec"].dataType.simpleString():
        out = out.withColumn("vec", F.col("vec").cast("array<double>"))
    return out.where(V.dim_ok("vec", dim) & ~F.exists("vec", lambda x: x.isNull()))


def topk_batch(docs: DataFrame, queries: DataFrame, k: int | None = None, *,
               doc_id: str = "doc_id", doc_vec: str = "embedding",
               query_id: str = "query_id", query_vec: str = "embedding",
               dim: int, kind: str = "dense", params: Params | None = None,
               block_rows: int | None = None, cells: int | None = None, n_probe: int | None = None) -> DataFrame:
    """Exact top-k for every query: ``(query_id, rank, doc_id, similarity)``
    (``query_id`` may also be a list of key columns, kept by name).

    ``kind`` describes both vector columns: ``'dense'`` = ``ARRAY<FLOAT|DOUBLE>``
    of length ``dim`` (other lengths are dropped, see ``dim_ok``);
    ``'buckets'`` = hashed bucket lists; ``'tokens'`` = token lists hashed
    with the md5 bucket rule. Every query row is answered on its own, also where
    ids repeat; document ids may be numbers or strings.

    Documents are packed in blocks of ``block_rows`` rows (by default
    ``Params.block_bytes`` of vectors, fewer if not every core would get one) and grouped in ``cells`` by direction (by
    default one per four blocks, at most ``MAX_CELLS``); each query visits its
    ``n_probe`` nearest cells (default an eighth) and then only the cells that can
    hold a better document. The result does not depend on these three. One count
    of the documents is run when the plan is built; grouping in more than one cell
    also writes them once. Nothing but cell centres passes through the driver."""
    params = params or Params()
    k = params.top_k if k is None else k
    if k < 0:
        raise ValueError("k must be >= 0")
    spark = docs.sparkSession
    keys = ["query_id"] if isinstance(query_id, str) else list(query_id)
    own = [query_id] if isinstance(query_id, str) else keys
    named = [F.col(f"k{i}").alias(c) for i, c in enumerate(keys)]
    q = queries.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(own)], F.col(query_vec).alias("v"))
    if kind == "dense":
        q = q.where(V.dim_ok("v", dim) & ~F.exists("v", lambda x: x.isNull()))
        q = q if "float" in q.schema["v"].dataType.simpleString() else q.withColumn("v", F.col("v").cast("array<double>"))
    else:
        q = B.dense(q.where(F.col("v").isNotNull()), dim, kind)
    d = vector_rows(docs, doc_id, doc_vec, dim, kind)
    id_type = d.schema["id"].dataType.simpleString()
    if k == 0:
        fields = ", ".join(f"`{c}` {q.schema[f'k{i}'].dataType.simpleString()}" for i, c in enumerate(keys))
        return spark.createDataFrame([], f"{fields}, rank int, doc_id {id_type}, similarity double")
    q = saved(q.withColumn("qid", F.monotonically_increasing_id()), "queries")     # fixes each query row's number
    ask = q.select("qid", F.col("v").alias("vec"))
    block = block_rows or max(1, params.block_bytes // (dim * (4 if B.vector_type(d) == "<f4" else 8)))
    rows = docs.count()
    n = cells if cells is not None else min(B.MAX_CELLS, rows // (4 * block))
    if block_rows is None:
        block = min(block, max(1024, -(-rows // B.slots(docs))))
    grouped, cells_ = (d.withColumn("cell", F.lit(0)), B.one_cell(dim, rows)) if n <= 1 else B.group(d, rows, n, dim)
    stored = B.blocks(grouped, cells_, dim, block)
    if cells_.n > 1:
        stored = saved(stored, "vector-blocks")                                    # read by both rounds
    top = B.search_pruned(stored, ask, cells_, k, dim, block, B.vector_type(d), n_probe or max(1, cells_.n // 8), asked=q.count())
    # As many rows as queries: merged, not gathered on the driver for a broadcast.
    return top.join(q.drop("v").hint("merge"), "qid").select(*named, F.col("rank").cast("int").alias("rank"), "doc_id", "similarity")


def topk_text(docs: DataFrame, queries: DataFrame, k: int | None = None, *,
              doc_id: str = "doc_id", doc_text: str = "text",
              query_id: str = "query_id", query_text: str = "text",
              dim: int = 256, params: Params | None = None) -> DataFrame:
    """Text-to-text retrieval over hashed term-frequency vectors."""
    # Tokens are split JVM-side; their distinct words are hashed once per Arrow batch.
    d = docs.select(F.col(doc_id).alias(doc_id), tokens(doc_text).alias("_b"))
    # A NULL query text has no embedding: it is dropped, like a failed embed.
    qcols = [query_id] if isinstance(query_id, str) else list(query_id)
    q = queries.select(*qcols, tokens(query_text).alias("_b"))
    return topk_batch(d, q, k, doc_id=doc_id, doc_vec="_b", query_id=query_id,
                      query_vec="_b", dim=dim, kind="tokens", params=params)


def topk_stored(kb: DataFrame, queries: DataFrame, k: int | None = None, *, query_id="query_id",
                query_text: str = "text", dim: int = 256, embed=None, params: Params | None = None) -> DataFrame:
    """Retrieval over the vectors stored in the knowledge base: only the queries
    are embedded, with the embedder of the ingest (``embed(list[str])``, default
    hashed). A query that cannot be embedded has no answer."""
    qcols = [query_id] if isinstance(query_id, str) else list(query_id)
    if embed is None:
        q = B.dense(queries.where(F.col(query_text).isNotNull()).select(*qcols, tokens(query_text).alias("_v")), dim, "tokens")
    else:
        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def vec(col: pd.Series) -> pd.Series:
            def one(t):
                try:
                    return None if t is None else [float(x) for x in embed([t])[0]]
                except Exception:  # noqa: BLE001 - no vector, no answer
                    return None
            return pd.Series([one(t) for t in col])
        q = queries.select(*qcols, vec(query_text).alias("_v"))
    return topk_batch(kb, q, k, doc_id="doc_id", doc_vec="embedding", query_id=query_id, query_vec="_v", dim=dim, params=params)


def attach_hits(topk: DataFrame, docs: DataFrame, doc_id: str = "doc_id",
                cols: tuple[str, ...] = ("text", "url")) -> DataFrame:
    """Hit projection ``{text, url, similarity}``: join winners to their rows.

    Every winner's id comes from ``docs``, so an inner join is exact. Inner
    (not left) matters at scale: the winners side (k per query) is the small
    one and may be the broadcast build side, or feed a runtime filter on the
    document scan, instead of shuffling the whole document table by id.
    """
    return docs.select(doc_id, *cols).join(topk, doc_id, "inner")
