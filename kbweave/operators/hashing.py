"""Feature hashing of token lists inside Arrow batches.

Bucket rule (fixed, shared with the SQL oracle and ``functions.text.md5_bucket``):
first 32 bits of md5 over the token's UTF-8 bytes, modulo the dimension.
Token frequencies are Zipf-like, so a bounded per-task memo answers most
lookups without hashing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


SLICE_ROWS = 256     # rows of an Arrow batch that are Python objects or dense vectors at once


class TokenBuckets:
    def __init__(self, dim: int, cap: int = 1 << 17):
        self.dim, self.cap, self.memo = dim, cap, {}

    def __call__(self, toks) -> np.ndarray:
        memo, dim = self.memo, self.dim
        out = np.empty(len(toks), dtype=np.int64)
        for i, t in enumerate(toks):
            b = memo.get(t)
            if b is None:
                b = int.from_bytes(hashlib.md5(t.encode("utf-8")).digest()[:4], "big") % dim
                if len(memo) < self.cap:
                    memo[t] = b
            out[i] = b
        return out


def counted(col: pa.Array, dim: int, hasher: TokenBuckets | None) -> np.ndarray:
    """Counts of the buckets of token lists (hashed by ``hasher``) or of bucket lists, a row each; null counts as empty."""
    n, flat = len(col), col.flatten()
    if hasher:
        coded = flat.dictionary_encode()
        flat = hasher(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)] \
            if len(flat) else np.zeros(0, np.int64)
    else:
        flat = flat.to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    return np.bincount(np.repeat(np.arange(n), size) * dim + flat, minlength=n * dim).reshape(n, dim)


def sliced(batches: Iterator[pa.Array], rows: int = SLICE_ROWS) -> Iterator[pa.Array]:
    """Arrow batches in short slices, so that what a step makes of one stays small."""
    for col in batches:
        for lo in range(0, len(col), rows):
            yield col.slice(lo, rows)


def vector_lists(m: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The rows of a matrix as Arrow lists of single-precision numbers."""
    ends = pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32))
    mask = None if null is None or not null.any() else pa.array(null)
    return pa.ListArray.from_arrays(ends, pa.array(m.astype(np.float32).ravel()), mask=mask)


def _nulls(col: pa.Array) -> np.ndarray:
    return col.is_null().to_numpy(zero_copy_only=False)


SPARSE_TF = T.StructType([T.StructField("bucket", T.ArrayType(T.IntegerType())),
                          T.StructField("tf", T.ArrayType(T.LongType()))])


def sparse_tf_udf(dim: int):
    """Token list -> ``STRUCT<bucket ARRAY<INT>, tf ARRAY<LONG>>`` (non-zero
    buckets ascending): one row's term frequencies, counted in the row."""
    @F.arrow_udf(SPARSE_TF)
    def sparse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        h = TokenBuckets(dim)
        for toks in sliced(batches):
            m = counted(toks, dim, h)
            rows, buckets = np.nonzero(m)
            ends = pa.array(np.searchsorted(rows, np.arange(len(m) + 1)).astype(np.int32))
            null = _nulls(toks)
            mask = pa.array(null) if null.any() else None
            yield pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(ends, pa.array(x), mask=mask) for x in (buckets.astype(np.int32), m[rows, buckets].astype(np.int64))],
                ["bucket", "tf"])
    return sparse


def dense_tf_udf(dim: int):
    """Token list -> dense ``ARRAY<FLOAT>`` term-frequency vector."""
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def dense(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        h = TokenBuckets(dim)
        for toks in sliced(batches):
            yield vector_lists(counted(toks, dim, h), _nulls(toks))
    return dense


def dense_texts_udf(dim: int):
    """Text list -> list of dense term-frequency vectors (null in a list gives null)."""
    from kbweave.functions.text import token_lists

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.FloatType())))
    def dense(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        h = TokenBuckets(dim)
        for lists in sliced(batches):
            texts = lists.flatten()                                  # of the lists that are not null
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            null = _nulls(lists)
            null[np.repeat(np.arange(len(lists)), size)[_nulls(texts)]] = True
            ends = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
            yield pa.ListArray.from_arrays(ends, vector_lists(counted(texts, dim, h)), mask=pa.array(null) if null.any() else None)
    return lambda texts: dense(token_lists(texts))


def hashed_vectors(dim: int):
    """The default embedder as a callable ``list[str] -> list[vector]``."""
    def embed(texts: list[str]) -> list[np.ndarray]:
        from kbweave.functions.text import py_tokens
        h = TokenBuckets(dim)
        return [np.bincount(h(t), minlength=dim).astype(np.float32) if t else np.zeros(dim, np.float32)
                for t in map(py_tokens, texts)]
    return embed
