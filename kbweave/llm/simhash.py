"""SimHash near-duplicates with multi-index hashing.

A document's fingerprint is the bitwise majority over the XXH64 values of its
word shingles. Two fingerprints link when at most ``max_bits`` bits differ. The
search never compares all pairs: the 64 bits are cut into segments; two
fingerprints within ``max_bits`` agree on one segment up to
``max_bits // segments`` bits, so each distinct fingerprint enumerates the small
Hamming ball of every segment value, the balls meet in a hash table (a shuffle
on the segment key) and each table match is verified on all 64 bits.

The ball is split over both sides: with radius ``r`` a fingerprint enters the
table under all keys at most ``ceil(r / 2)`` bits from its segment, and two
segments at distance ``r`` or less then share a key. That keeps two wide
segments (32 bits, so sparse tables) for ``max_bits`` up to 5 at 33 keys each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbweave.llm.common import give_back, saved
from kbweave.llm.components import connected_components

SEED = 42
_DOCS = 256          # texts that are Python objects at once
SEGMENTS = 2


def fingerprint_bytes(text: bytes, shingle: int) -> int:
    """Fingerprint of one text. ASCII letters are lower-cased and words are the
    runs between ASCII white space, which is what bytes.lower and bytes.split do."""
    words = text.lower().split()
    n = len(words)
    if n == 0:
        return 0
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        flat = b" ".join(words)
        length = np.fromiter(map(len, words), np.int64, n)
        start = np.zeros(n, np.int64)
        np.cumsum(length[:-1] + 1, out=start[1:])
        end = start + length
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[a:b], SEED) for a, b in
                  zip(start[:n - shingle + 1].tolist(), end[shingle - 1:].tolist(), strict=True)]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp long)`` for each row; whole texts, null counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(lo, _DOCS) for x in batches for lo in range(0, x.num_rows, _DOCS)):
            fps = [fingerprint_bytes(t or b"", shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
            fp = np.array(fps, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])
        give_back()

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fp long")


def ball(width: int, radius: int) -> np.ndarray:
    """All XOR masks of at most ``radius`` bits below ``width``."""
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(1 << i for i in c) for c in combinations(range(width), r)]
    return np.array(masks, dtype=np.uint64)


def segment_keys(fp: np.ndarray, max_bits: int, segments: int = SEGMENTS) -> np.ndarray:
    """Table keys, one row per fingerprint: the segment's number in the top
    bits, then a value of the ball round the segment's bits."""
    width = 64 // segments
    masks = ball(width, -(-(max_bits // segments) // 2))
    low = np.uint64((1 << width) - 1)
    out = [((fp >> np.uint64(s * width)) & low)[:, None] ^ masks[None, :] | np.uint64(s << (64 - 8))
           for s in range(segments)]
    return np.concatenate(out, axis=1)


def _forest(fp: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected among ``fp``: breadth-first, each
    fingerprint compared with those not yet reached, one link per reached one."""
    left, out = fp[1:], []
    queue = [fp[:1]]
    while len(left):
        if not queue:
            queue, left = [left[:1]], left[1:]
            continue
        front = queue.pop()
        for f in front:
            near = np.bitwise_count(left ^ f) <= max_bits
            if near.any():
                hit = left[near]
                out.append((np.full(len(hit), f, np.uint64), hit))
                queue.append(hit)
                left = left[~near]
                if not len(left):
                    break
    return out


def _links(max_bits: int):
    """Sorted (key, fp) batches -> verified links. Groups of up to 32 compare by
    offset over the whole batch; a larger group yields a spanning forest, so a
    group never emits all its pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def emit(k, f):
            a, b = [], []
            edge = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
            size = np.diff(edge)
            big = np.flatnonzero(size > 32)
            small = np.repeat(size <= 32, size)
            ks, fs = k[small], f[small]
            top = int(size[size <= 32].max(initial=1))
            for d in range(1, top):
                near = (ks[d:] == ks[:-d]) & (np.bitwise_count(fs[d:] ^ fs[:-d]) <= max_bits)
                a.append(fs[:-d][near])
                b.append(fs[d:][near])
            for g in big:
                for x, y in _forest(f[edge[g]:edge[g + 1]], max_bits):
                    a.append(x)
                    b.append(y)
            u = np.concatenate(a) if a else np.zeros(0, np.uint64)
            v = np.concatenate(b) if b else np.zeros(0, np.uint64)
            pair = np.unique(np.stack([u.view(np.int64), v.view(np.int64)], axis=1), axis=0) if len(u) else \
                np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["u", "v"])

        for batch in batches:
            k = np.concatenate([rest_k, batch.column(0).to_numpy()])
            f = np.concatenate([rest_f, batch.column(1).to_numpy().view(np.uint64)])
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1], "left"))
            rest_k, rest_f = k[cut:], f[cut:]
            if cut:
                yield emit(k[:cut], f[:cut])
        if len(rest_k):
            yield emit(rest_k, rest_f)
    return run


def fingerprint_links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """``(u, v)``: links between distinct fingerprints ``fps(fp)`` whose
    transitive closure is that of all pairs within ``max_bits`` bits."""
    def enumerate_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 4096):
                part = fp[at:at + 4096]
                keys = segment_keys(part, max_bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)),
                     pa.array(np.repeat(part, keys.shape[1]).view(np.int64))], ["k", "fp"])

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = (fps.select("fp").mapInArrow(enumerate_keys, "k long, fp long")
             .repartition(n, "k").sortWithinPartitions("k"))
    return table.mapInArrow(_links(max_bits), "u long, v long").distinct()


def simhash_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``(id_col, fingerprint, component_id)``, one row per input row.

    ``component_id`` is the smallest id reachable over links of at most
    ``max_bits`` differing bits. Equal fingerprints are one node, so copies never
    become pairs. Null or word-less text has fingerprint zero and is linked like
    any other; a text with fewer words than a shingle is one shingle. A null id
    keeps its row and counts as no candidate for the smallest id. Repeated rows
    give repeated rows; an empty table gives none; other columns are ignored."""
    fps = saved(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    nodes = saved(fps.groupBy("fp").agg(F.min("id").alias("low")), "simhash-nodes")
    comp = connected_components(fingerprint_links(nodes, max_bits))
    member = nodes.join(comp, nodes["fp"] == comp["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("low").alias("component_id"))
    where = member.join(lowest, "root").select(F.col("fp"), "component_id")
    return (fps.join(where, "fp")
            .select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    "component_id"))


def near_dedup(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of its group (all columns kept).
    Rows that repeat the kept id are all kept; a null id is kept only in a
    group without any id."""
    groups = simhash_groups(docs, shingle, max_bits, id_col, text_col)
    keep = groups.where(F.col("component_id").eqNullSafe(F.col(id_col))).select(F.col(id_col).alias("_keep_id")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep["_keep_id"]), "left_semi")
