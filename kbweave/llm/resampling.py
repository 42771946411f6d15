"""Importance resampling towards a target distribution of hashed word n-grams.

A text's features are its runs of 1 to ``n`` words. A feature's bucket is its CRC-32
modulo the number of buckets. All documents give one count per bucket, all target
texts another; a bucket's gain is the scaled logarithm of the smoothed ratio, a
document's weight the mean gain of its features. Adding Gumbel noise derived from
the document's id turns "the highest scores" into a draw without replacement.

The CRCs of a tile's distinct features are computed together: features of one
byte length form a two-dimensional uint8 array, whose columns update all CRCs of
that length at once, and the buckets are scattered back to the features' places.

Two passes over the texts: one adds up bucket counts (one row per bucket and
task is shuffled), one scores each document where its text is read. Only the
gains (one number per bucket) are broadcast. Ranks come from a range-partitioned
index, not from a global window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbweave.llm.common import saved, text_bytes
from kbweave.llm.wordscan import LOWER, byte_set, find_words, tiles
from kbweave.plans.lookback import global_index

MAX_BUCKETS = 1 << 20
POLYNOMIAL = 0xEDB88320          # CRC-32, reflected
TILE = 8 << 20                   # bytes of text worked on at once
#: Word bytes after lower-casing: 0-9, a-z and everything outside ASCII.
WORD = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


CRC = _crc_table()


def crc32_all(values: pa.Array) -> np.ndarray:
    """CRC-32 of every value of a binary array, one byte length at a time."""
    data, off = text_bytes(values)
    length = np.diff(off)
    out = np.zeros(len(values), np.uint32)
    order = np.argsort(length, kind="stable")
    for n, lo, hi in _groups(length[order]):
        step = max(1, (4 << 20) // max(n, 1))
        for at in range(lo, hi, step):
            rows = order[at:min(at + step, hi)]
            columns = data[np.arange(n)[:, None] + off[rows]]       # one row per byte place
            crc = np.full(rows.size, 0xFFFFFFFF, np.uint32)
            for column in columns:
                crc = CRC[(crc ^ column) & 0xFF] ^ (crc >> 8)
            out[rows] = ~crc
    return out


def _groups(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(key, from, to)`` of each run of equal keys."""
    if sorted_keys.size:
        cut = np.r_[0, np.flatnonzero(np.diff(sorted_keys)) + 1, sorted_keys.size]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            yield int(sorted_keys[lo]), int(lo), int(hi)


def feature_buckets(texts: pa.Array, n: int, buckets: int, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """``(row, bucket, length)``: arrays of the features of a batch of texts, by
    tile and by the feature's number of words."""
    data, off = text_bytes(texts)
    if not data.size:
        return
    low = LOWER[data]
    word = WORD[low]
    cut = ~word
    cut[off[1:-1][off[1:-1] > 0] - 1] = True
    back = 0                                    # bytes of the last n - 1 words of the tile before
    for lo, hi in tiles(cut, tile):
        lo -= back
        edges = off[np.searchsorted(off, lo):np.searchsorted(off, hi, "right")] - lo
        vocab, code, start = find_words(low[lo:hi], word[lo:hi], edges)
        old = int(np.searchsorted(start, back))  # words that the tile before has seen
        row = np.searchsorted(off, start + lo, "right") - 1
        names, at = vocab, code
        for k in range(1, n + 1):
            if k > 1:
                last = code[k - 1:]
                same = row[:last.size] == row[k - 1:]
                pair = at[:last.size] * len(vocab) + last
                at, distinct = pd.factorize(np.where(same, pair, -1))
                names = _joined(names, vocab, distinct)
                here = same.copy()
            else:
                here = np.ones(at.size, bool)
            here[:max(0, old - k + 1)] = False
            bucket = (crc32_all(names) % np.uint32(buckets)).astype(np.int64)
            yield row[:at.size][here], bucket[at[here]], k
        tail = start[max(0, start.size - n + 1):] if n > 1 else start[:0]
        back = hi - lo - int(tail[0]) if tail.size else 0


def _joined(names: pa.Array, vocab: pa.Array, pair: np.ndarray) -> pa.Array:
    """As the join in ``feature_buckets``, with an empty name for the code of places that cross a text."""
    ok = pair >= 0
    a, b = (pa.array(np.where(ok, x, 0)) for x in (pair // max(len(vocab), 1), pair % max(len(vocab), 1)))
    return pc.binary_join_element_wise(names.take(a), vocab.take(b), b" ")


def _counts(df: DataFrame, text_col: str, n: int, buckets: int) -> tuple[np.ndarray, int]:
    """Features per bucket, and of all buckets, over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, bucket, _ in feature_buckets(b.column(0), n, buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])
    rows = (df.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())      # at most one row per bucket
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out, int(out.sum())


def bucket_gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B))))`` of each of B buckets, in doubles."""
    b, all_s, all_t = s.size, float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((float(y) + 1) * (all_s + b) / ((float(x) + 1) * (all_t + b))))
                     for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def rank_documents(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, percent: int = 25,
                   min_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
                   target_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document's ``(id, [keep], n_features, weight, score, rank)``.

    Words are runs of ASCII digits, ASCII letters (lower-cased) and all characters
    beyond ASCII. ``rank`` counts the drawn documents from the highest score on:
    ``floor(percent * N / 100)`` of the N with ``min_words`` words or more; ties go
    to the smaller id (null first), then in any order; the others have null.

    A null or empty text has no feature and weight 0, a null id counts as an empty
    string in the noise. Repeated rows are scored and drawn each for itself. An
    empty table gives no rows, an empty target gives gains of documents alone.
    Texts of any length: tiles of ``TILE`` bytes, n-grams across their ends
    included. Columns of the four output names are replaced."""
    if not 1 <= buckets <= MAX_BUCKETS or n < 1:
        raise ValueError(f"1 to {MAX_BUCKETS} buckets and n of 1 or more")
    spark = docs.sparkSession
    s, _ = _counts(docs, text_col, n, buckets)
    t, _ = _counts(target, target_col, n, buckets)
    gains = spark.sparkContext.broadcast(bucket_gains(s, t))
    made = ("n_features", "weight", "score", "rank")
    keep = tuple(c for c in keep if c not in made and c != id_col)
    width = len(keep) + 1                       # inside, columns go by number: no name can clash
    src = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate((id_col, *keep))],
                      F.col(text_col).cast("string").alias("t"))
    names = ["words", "feats", "mean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = gains.value
        for b in batches:
            rows = b.num_rows
            words, feats, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for row, bucket, k in feature_buckets(b.column(width), n, buckets):
                count = np.bincount(row, minlength=rows)
                feats += count
                words += count if k == 1 else 0
                total += np.bincount(row, weights=gain[bucket], minlength=rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:width], *(pa.array(x) for x in (words, feats, total // np.maximum(feats, 1)))],
                [*b.schema.names[:width], *names])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema[:width])
    scored = src.mapInArrow(run, fields + "".join(f", {c} long" for c in names))
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("c0").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(seeded, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = saved(scored.withColumn("score", F.col("mean") + noise.cast("long"))
                   .withColumn("number", F.monotonically_increasing_id()), "resampling")
    enough = F.col("words") >= min_words
    drawn = scored.where(enough).count() * percent // 100
    ranked = global_index(scored.where(enough).withColumn("down", -F.col("score"))
                          .withColumn("tie", F.struct("c0", "number")), "down", "tie", 1_000_000)
    out = [*[F.col(f"c{i}").alias(c) for i, c in enumerate((id_col, *keep))], F.col("feats").alias("n_features"),
           F.col("mean").alias("weight"), "score"]
    rank = F.when(F.col("_g") < drawn, F.col("_g") + 1).cast("long").alias("rank")
    return ranked.select(*out, rank).unionByName(
        scored.where(~enough).select(*out, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn documents with all their columns, and n_features, weight, score and rank."""
    keep = tuple(c for c in docs.columns if c != id_col)
    return rank_documents(docs, target, id_col=id_col, text_col=text_col, keep=keep, **options).where(F.col("rank").isNotNull())
