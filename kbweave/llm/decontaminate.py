"""Benchmark decontamination by latent semantic retrieval.

1. Terms (lower-cased words without ASCII punctuation) are hashed to a fixed
   number of buckets. All documents are cut into passages; one pass counts the
   passages of each bucket, which gives the IDF weights.
2. Distributed randomised SVD: with ``A`` the passage-by-bucket TF-IDF matrix
   and ``O`` a random matrix, tasks add up ``A'(A O)`` over their own passages and
   the blocks of rows are summed by a shuffle. Its orthonormal basis, turned by
   the small eigenproblem, holds the leading right singular vectors. Size
   depends on the parameters alone.
3. Every document's sliding windows are projected and compared by cosine with
   the items, in blocks of items. Beside them, every place that shares three
   words in a row with an item is a candidate, so an item copied as it is gets
   found however often it is leaked. Candidates are checked on words: the longest
   common subsequence with the item, and that of the item's answer part (its
   closing words), both as shares of the item. So a match needs the item's words
   in the item's order, with room for changed, added and dropped ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbweave.llm.common import shuffle_n, text_bytes
from kbweave.llm.textvec import SPACE, Prefix, add_rows, let_go, mix, slices

# Bytes that separate terms: white space and ASCII punctuation.
_BREAK = SPACE.copy()
_BREAK[np.frombuffer(bytes(c for c in range(128) if not chr(c).isalnum()), np.uint8)] = True


TILE = 1 << 19                    # bytes of text that are counted or searched at once
SIGNS = 1 << 24                   # bytes of the word signatures of a block of items, at most
CHECKED = 1 << 11                 # windows whose words are counted at once


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 14      # hashed terms
    rank: int = 64              # latent dimensions
    extra: int = 8              # oversampling of the random matrix
    passage: int = 32           # words of a passage of the matrix
    scales: tuple[int, ...] | None = None    # words of the search windows, each twice the last; None: by the items' lengths
    shingle: int = 3            # words in a row that make a place a candidate of its own
    min_cosine: float = 0.6
    min_lcs: float = 0.7        # share of the item's words in common, in order
    answer: float = 0.25        # closing share of the item that counts as its answer
    min_answer: float = 0.5     # share of the answer's words in common, in order
    block_words: int = 1 << 18  # words of the items compared in one pass


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, row)`` of all terms of a string column in order."""
    buf, off = text_bytes(pc.utf8_lower(texts))
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~_BREAK[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | cut[1:len(buf)]
    end[:-1] &= ~solid[1:] | cut[1:len(buf)]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Prefix(buf)(s, e), np.searchsorted(off, s, "right") - 1


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> np.uint64(17)).astype(np.int64) & (n - 1)


def _first(row: np.ndarray) -> np.ndarray:
    """Number of each place within its row."""
    return np.arange(len(row)) - np.searchsorted(row, row, "left")


def passage_ids(row: np.ndarray, size: int) -> np.ndarray:
    """Numbers the pieces of ``size`` places within each row, from 0 on."""
    new = (_first(row) % size) == 0
    return np.cumsum(new) - 1


def _spread(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("text"))


def passage_frequencies(docs: DataFrame, s: Settings, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Passages with each bucket, and all passages, over every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(s.buckets, np.int64), 0
        for b in batches:
            for at, to in slices(b, 0, TILE):
                h, row = terms(b.slice(at, to - at).column(0))
                if not len(h):
                    continue
                p = passage_ids(row, s.passage)
                pair = pd.unique(p * s.buckets + _bucket(h, s.buckets))
                df += np.bincount(pair & (s.buckets - 1), minlength=s.buckets)
                n += int(p[-1]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(df), -1)),
                                          pa.array(np.append(df[df > 0], n))], ["bucket", "n"])
        let_go()

    found = (_spread(docs, text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas())
    df = np.zeros(s.buckets, np.int64)
    got = dict(zip(found["bucket"], found["n"], strict=True))
    n = int(got.pop(-1, 0))
    df[list(got)] = list(got.values())
    return df, n


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """IDF, above zero for every term: a leaked item's own terms are frequent."""
    return np.log((n + 2) / (df + 1)).astype(np.float32)


def _piece_sums(table: np.ndarray, t: np.ndarray, edge: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``table[t]`` over pieces of at most ``size`` places that start at ``edge``."""
    end, out = np.append(edge[1:], len(t)), table[t[edge]]
    for k in range(1, size):
        some = np.flatnonzero(edge + k < end)
        out[some] += table[t[edge[some] + k]]
    return out


def latent_basis(docs: DataFrame, w: np.ndarray, s: Settings, text_col: str = "text") -> np.ndarray:
    """``buckets x rank``: leading right singular vectors of the TF-IDF matrix over
    their singular values (the usual folding-in of new text, which keeps a few
    strong directions from making all cosines alike), each row times the
    bucket's weight."""
    k, rows = s.rank + s.extra, 64
    omega = np.random.default_rng(11).standard_normal((s.buckets, k)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((w, omega * w[:, None]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, wo = shared.value
        b_sum = np.zeros((s.buckets, k))
        for b in batches:
            for at, to in slices(b, 0):
                h, row = terms(b.slice(at, to - at).column(0))
                if not len(h):
                    continue
                p, t = passage_ids(row, s.passage), _bucket(h, s.buckets)
                edge = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
                add_rows(b_sum, t, _piece_sums(wo, t, edge, s.passage), p)
        b_sum *= w[:, None]
        for blk in range(s.buckets // rows):
            part = b_sum[blk * rows:(blk + 1) * rows]
            yield pa.RecordBatch.from_arrays([pa.array([blk]), pa.array([part.astype(np.float32).tobytes()], pa.binary())],
                                              ["blk", "part"])
        del b_sum, wo
        let_go()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for blk, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = np.frombuffer(part, np.float32).astype(np.float64)
                total[blk] = total[blk] + m if blk in total else m
        for blk, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([blk]), pa.array([m.tobytes()], pa.binary())], ["blk", "part"])

    parts = (_spread(docs, text_col).mapInArrow(run, "blk long, part binary")
             .repartition(min(s.buckets // rows, shuffle_n(docs.sparkSession)), "blk").mapInArrow(add, "blk long, part binary"))
    b = np.zeros((s.buckets, k))
    for r in parts.collect():                      # buckets x k numbers, whatever the input
        b[r["blk"] * rows:(r["blk"] + 1) * rows] = np.frombuffer(r["part"]).reshape(rows, k)
    q, _ = np.linalg.qr(b)
    small = (q.T @ b) @ np.linalg.pinv(q.T @ omega.astype(np.float64))
    val, vec = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-val)[:s.rank]
    v = (q @ vec[:, top]) / np.sqrt(np.maximum(val[top], val.max() * 1e-9 + 1e-12))
    return (v * w[:, None]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(n, 1e-12)[:, None]


def lcs(item: np.ndarray, region: np.ndarray) -> tuple[int, np.ndarray]:
    """Length of the longest common subsequence, and which item words one such takes."""
    pos: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        pos[x] = pos.get(x, 0) | (1 << i)
    full = (1 << len(item)) - 1
    v, states = full, []
    for x in region.tolist():
        m = pos.get(x, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
        states.append(v)
    taken = np.zeros(len(item), bool)
    i, j = len(item) - 1, len(states) - 1
    while i >= 0 and j >= 0:                       # a zero bit i: the length grows at item word i
        if states[j] >> i & 1:
            i -= 1
        elif j and not states[j - 1] >> i & 1:
            j -= 1
        else:
            taken[i] = True
            i, j = i - 1, j - 1
    return int(taken.sum()), taken


def check(item: np.ndarray, region: np.ndarray, s: Settings) -> tuple[float, float]:
    """Shares of the item and of its answer in common with the region. Too few
    shared words to reach ``min_lcs`` settle it without the subsequence."""
    own = set(item.tolist())
    if sum(x in own for x in region.tolist()) < s.min_lcs * len(item):
        return 0.0, 0.0
    n, taken = lcs(item, region)
    closing = max(1, round(s.answer * len(item)))
    return n / len(item), float(taken[-closing:].mean())


def window_scales(size: np.ndarray) -> tuple[int, ...]:
    """Powers of two from the one nearest to the shortest item (4 at least) to
    the longest item or more."""
    size = size[size > 0]
    if not len(size):
        return ()
    low = max(2, round(float(np.log2(size.min()))))
    return tuple(1 << e for e in range(low, max(low, int(size.max() - 1).bit_length()) + 1))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` terms from each place on."""
    n = max(0, len(h) - k + 1)
    x = np.zeros(n, np.uint64)
    for i in range(k):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n])
    return x


class Items:
    """A block of items: words, latent vectors and the scale of each."""

    def __init__(self, ids: list, texts: list[str], basis: np.ndarray, s: Settings):
        h, row = terms(pa.array([t or "" for t in texts], pa.string()))
        self.ids = ids
        self.words = [h[row == i] for i in range(len(ids))]
        vec = np.zeros((len(ids), basis.shape[1]), np.float32)
        np.add.at(vec, row, basis[_bucket(h, s.buckets)])
        self.vec = _unit(vec)
        self.size = size = np.array([len(x) for x in self.words], np.int64)
        self.scales = window_scales(size) if s.scales is None else s.scales
        gap = np.abs(np.log(np.maximum(size, 1))[:, None] - np.log(np.array(self.scales, np.int64))[None, :])
        usable = np.einsum("ij,ij->i", vec, vec) > 1e-12
        # Shingles of the items with their item and first place there; shorter items are one shingle.
        self.shingles = {}
        for k in np.unique(np.minimum(size[size > 0], s.shingle)).tolist():
            own = np.flatnonzero(np.minimum(size, s.shingle) == k)
            key = [np.unique(shingle_hashes(self.words[i], k), return_index=True) for i in own]
            key, at = np.concatenate([x[0] for x in key]), np.concatenate([x[1] for x in key])
            of = np.repeat(own, [len(np.unique(shingle_hashes(self.words[i], k))) for i in own])
            order = np.argsort(key, kind="stable")
            self.shingles[k] = key[order], of[order], at[order]
        # Signatures: a flag for each hash of a word modulo a power of two. Words may share a flag, so a
        # region has at most as many of an item's words as flags say.
        self.signs = np.zeros((len(ids), 1 << min(12, max(6, (SIGNS // max(1, len(ids))).bit_length() - 1))), bool)
        self.signs[row, (h & np.uint64(self.signs.shape[1] - 1)).astype(np.int64)] = True
        # An item meets the windows of the nearest scale and of any less than a factor of two off.
        near = (gap < np.log(2) - 1e-9) | (gap == gap.min(axis=1, keepdims=True, initial=np.inf))
        self.by_scale = [np.flatnonzero(near[:, i] & usable) for i in range(len(self.scales))]


def shared_shingles(h: np.ndarray, row: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """``(row, item, from, to)``: the place where an item would stand for each
    shingle that a row shares with it, widened by a quarter on both sides."""
    rows = np.arange(int(row[-1]) + 1)
    first, last = np.searchsorted(row, rows, "left"), np.searchsorted(row, rows, "right")
    for k, (key, of, at) in items.shingles.items():
        x = shingle_hashes(h, k)
        lo = np.searchsorted(key, x, "left")
        n = np.searchsorted(key, x, "right") - lo
        n[row[:len(x)] != row[k - 1:]] = 0
        place = np.flatnonzero(n)
        lo, n = lo[place], n[place]
        pick = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place, item = np.repeat(place, n), of[pick]
        size = items.size[item]
        cell = np.maximum(1, size // 8)
        start = (place - at[pick] - first[row[place]]) // cell
        found = np.unique(np.stack([row[place], item, start, cell, size]), axis=1)
        for r, i, c, w, m in found.T.tolist():
            a = int(first[r]) + c * w
            yield r, i, int(max(first[r], a - m // 4)), int(min(last[r], a + w + m + m // 4))


def enough_words(sign: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, items: Items, s: Settings) -> np.ndarray:
    """Which regions ``[lo, hi)`` may hold the words of their item that ``check`` asks for; those
    left out lack them. ``sign`` is the flag's number of each place."""
    ok = np.empty(len(lo), bool)
    flat, width = items.signs.ravel(), items.signs.shape[1]
    for at in range(0, len(lo), CHECKED):
        a, n, i = lo[at:at + CHECKED], (hi - lo)[at:at + CHECKED], item[at:at + CHECKED]
        end = np.cumsum(n)
        place = np.repeat(a - (end - n), n) + np.arange(int(n.sum()))
        got = np.concatenate(([0], np.cumsum(flat[np.repeat(i * width, n) + sign[place]])))
        ok[at:at + CHECKED] = got[end] - got[end - n] >= s.min_lcs * items.size[i]
    return ok


def candidates(h: np.ndarray, row: np.ndarray, basis: np.ndarray, items: Items, s: Settings,
               min_cosine: float) -> Iterator[tuple[int, int, float, int, int]]:
    """``(row, item, cosine, from, to)``: every window of a row that reaches
    ``min_cosine`` with an item, widened by a quarter on both sides and by what
    the item is longer (places in ``h``); those of a pair by falling cosine. Windows
    with too few of the item's words for ``check`` are left out."""
    if not items.scales:
        return
    step = min(items.scales) // 2
    blk = passage_ids(row, step)
    edge = np.flatnonzero(np.concatenate(([True], blk[1:] != blk[:-1])))
    t = _bucket(h, s.buckets)
    sign = (h & np.uint64(items.signs.shape[1] - 1)).astype(np.int64)
    sums = _piece_sums(basis, t, edge, step)
    brow = row[edge]
    rows = np.arange(int(row[-1]) + 1)
    first, last = np.searchsorted(row, rows, "left"), np.searchsorted(row, rows, "right")
    in_row = np.arange(len(brow)) - np.searchsorted(brow, brow, "left")
    win, m = sums, 1
    for scale, own in zip(items.scales, items.by_scale, strict=True):
        while m * step < scale:                    # windows of 2m blocks from windows of m
            longer = win.copy()
            longer[:-m] += win[m:] * (brow[m:] == brow[:-m])[:, None] if m < len(win) else 0
            win, m = longer, 2 * m
        if not len(own):
            continue
        hop = max(1, m // 4)                       # windows start every quarter of their length
        starts = np.flatnonzero((in_row % hop) == 0)
        for at in range(0, len(starts), 2048):
            some = starts[at:at + 2048]
            w = win[some]
            norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", w, w)), 1e-12)
            dots = w @ items.vec[own].T
            hit = np.flatnonzero((dots >= min_cosine * norm[:, None]).ravel())
            if not len(hit):
                continue
            wi, ii = np.divmod(hit, len(own))
            item, at_word, x = own[ii], edge[some[wi]], brow[some[wi]]
            pad = scale // 4 + np.maximum(0, items.size[item] - scale)
            lo, hi = np.maximum(first[x], at_word - pad), np.minimum(last[x], at_word + scale + pad)
            ok = np.flatnonzero(enough_words(sign, lo, hi, item, items, s))
            c = (dots.ravel()[hit[ok]] / norm[wi[ok]])
            order = np.lexsort((-c, ii[ok]))
            ok = ok[order]
            yield from zip(x[ok].tolist(), item[ok].tolist(), c[order].tolist(), lo[ok].tolist(), hi[ok].tolist(), strict=True)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings(), id_col: str = "doc_id",
                      text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(id_col, item_col, cosine, lcs, answer)`` for every document and item
    that match, the best region of each pair.

    Whole texts are searched, items in blocks of ``block_words`` words. Null or
    word-less texts and items match nothing. A null id is carried on. Rows that share an id give one row per
    item, the best; empty tables give none; other columns are ignored."""
    spark = docs.sparkSession
    w = weights(*passage_frequencies(docs, s, text_col))
    basis = spark.sparkContext.broadcast(latent_basis(docs, w, s, text_col))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_t = src.schema["id"].dataType.simpleString()
    item_type = benchmark.schema[item_col].dataType
    item_t = item_type.simpleString()

    def search(ids: list, texts: list[str]) -> DataFrame:
        block = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(*block.value, basis.value, s)
            for b in batches:
                for at, to in slices(b, 1, TILE):
                    part = b.slice(at, to - at)
                    h, row = terms(part.column(1))
                    best: dict[tuple[int, int], tuple[float, float, float]] = {}
                    for r, i, cos, lo, hi in candidates(h, row, basis.value, items, s, s.min_cosine) if len(h) else ():
                        if best.get((r, i), (0.0,)) >= (1.0, 1.0, cos):
                            continue
                        share, answer = check(items.words[i], h[lo:hi], s)
                        if share >= s.min_lcs and answer >= s.min_answer:
                            best[r, i] = max(best.get((r, i), (0.0, 0.0, 0.0)), (share, answer, cos))
                    for r, i, lo, hi in shared_shingles(h, row, items) if len(h) else ():
                        share, answer = check(items.words[i], h[lo:hi], s)
                        if share >= s.min_lcs and answer >= s.min_answer:
                            v = basis.value[_bucket(h[lo:hi], s.buckets)].sum(axis=0, keepdims=True)
                            best[r, i] = max(best.get((r, i), (0.0, 0.0, 0.0)), (share, answer, float(_unit(v)[0] @ items.vec[i])))
                    out = [(r, i, cos, share, answer) for (r, i), (share, answer, cos) in best.items()]
                    c = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(c[0], pa.int64())), pa.array([items.ids[i] for i in c[1]], b_type),
                         *(pa.array(x, pa.float64()) for x in c[2:])], ["id", "item", "cosine", "lcs", "answer"])
            del items
            let_go()
        from pyspark.sql.pandas.types import to_arrow_type
        b_type = to_arrow_type(item_type)
        return src.mapInArrow(run, f"id {id_t}, item {item_t}, cosine double, lcs double, answer double")

    found, ids, texts, size = None, [], [], 0
    for r in benchmark.select(item_col, item_text).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len((r[1] or "").split())
        if size > s.block_words:
            more = search(ids, texts)
            found, ids, texts, size = more if found is None else found.union(more), [], [], 0
    if ids or found is None:
        more = search(ids, texts)
        found = more if found is None else found.union(more)
    best = found.groupBy("id", "item").agg(F.max(F.struct("lcs", "answer", "cosine")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("b.cosine").alias("cosine"),
                       F.col("b.lcs").alias("lcs"), F.col("b.answer").alias("answer"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings(), id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id matches no item (all columns; null ids stay
    unless a row with a null id matches)."""
    bad = benchmark_matches(docs, benchmark, s, id_col, text_col).select(F.col(id_col).alias("_bad")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]), "left_anti")
