"""Word phrases that stick together, mined by sample, negative border and closing passes.

A phrase is a run of words inside a piece of text. Which phrases of up to
``longest`` words occur ``min_count`` times or more in a language is found in
four steps:

1. A sample of the documents is mined level by level with a lowered threshold:
   its frequent phrases are the proposal.
2. A full pass counts, exactly, every proposed phrase and the negative border:
   every phrase that is not proposed although both its parts (without the last
   word, without the first) are. All single words belong to one or the other.
3. A border phrase that reaches ``min_count`` is a failure of the sample: longer
   phrases that contain it have not been counted. A further full pass counts
   exactly those whose two parts are now known frequent and were not before.
4. Passes go on until none brings a new frequent phrase.

A phrase cannot be more frequent than its parts, so the result is exact whatever
the sample held; the sample only decides how many passes there are.

What a pass knows of the frequent phrases is a bitmap of their hashes, of fixed
size and broadcast. A hash that stands in it by chance lets a phrase be counted
that need not be: counts stay exact, as the bitmap decides only what is counted,
phrases themselves are grouped by their words, and every later pass asks the
earlier bitmaps again, so no phrase is counted twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbweave.llm.common import saved, text_bytes
from kbweave.llm.wordscan import LOWER, byte_set, find_words, tiles

TILE = 4 << 20                   # bytes of text counted at once
SHARE_BYTES = 4 << 20            # bytes of text per share of the phrases that one group adds up
GAP = byte_set((0x09, 0x09), (0x20, 0x20))
BREAK = byte_set((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
WORD = ~(GAP | BREAK)
FILTER_BITS = 1 << 27            # 16 MB; eight or more bits for each frequent phrase keep it selective


def _mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (shifts and odd factors)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hashes(words: pa.Array, lang: bytes) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def _chain(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of all but its last word and the last word's."""
    return _mix(h * np.uint64(0x9E3779B97F4A7C15) + last)


def phrase_hashes(lang: str, phrases: pa.Array) -> np.ndarray:
    """Hashes of space-joined phrases (no nulls, none empty), as the passes compute them."""
    data, off = text_bytes(phrases)
    vocab, code, start = find_words(data, data != 0x20, off)
    h = _hashes(vocab, lang.encode())[code]
    first = np.searchsorted(start, off[:-1])
    size = np.diff(np.r_[first, start.size])
    out = h[first] if first.size else h
    for j in range(1, int(size.max(initial=0))):
        more = np.flatnonzero(size > j)
        out[more] = _chain(out[more], h[first[more] + j])
    return out


class Bitmap:
    """Set of hashes with chance hits; ``bits`` is a power of two."""

    def __init__(self, bits: int):
        self.bits = bits
        self.data = np.zeros(bits >> 6, np.uint64)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & np.uint64(self.bits - 1)
        return (self.data[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _tile_counts(buf: np.ndarray, off: np.ndarray, lang: bytes, longest: int, now: Bitmap | None,
                 before: Bitmap | None, words_too: bool) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """``(words, phrases, hashes, counts)`` of one tile, one level after the other.

    A phrase is reached if both its parts are on, and on if it is reached and
    stands in the bitmap (a word needs no parts). Reached phrases are counted, but
    for those that the bitmap of the pass before had reached already."""
    low = LOWER[buf]
    vocab, code, start = find_words(low, WORD[low], off)
    if not start.size:
        return
    word_h = _hashes(vocab, lang)
    if words_too:
        yield 1, vocab, word_h, np.bincount(code, minlength=len(vocab))
    if now is None or longest < 2:
        return
    wall = BREAK[low]
    wall[off[off < wall.size]] = True                       # a text's first byte begins a piece
    piece = np.cumsum(wall)[start]
    h, words = word_h, np.arange(len(vocab))[:, None]       # of each distinct phrase: hash, word codes
    on, was = now.has(h), before.has(h) if before else np.zeros(h.size, bool)
    at = np.where(on[code], code, -1)
    for k in range(2, longest + 1):
        a, b = at[:-1], at[1:]
        both = (a >= 0) & (b >= 0)
        if k == 2:
            both &= piece[:-1] == piece[1:]
        place = np.flatnonzero(both)
        if not place.size:
            return
        key, distinct = pd.factorize(a[place] * len(h) + b[place])
        left, right = distinct // len(h), distinct % len(h)
        last = words[right, -1]
        words = np.concatenate([words[left], last[:, None]], axis=1)
        h = _chain(h[left], word_h[last])
        was = was[left] & was[right]
        if not was.all():
            new = np.flatnonzero(~was)
            yield (k, pc.binary_join_element_wise(*[vocab.take(pa.array(words[new, j])) for j in range(k)], b" "), h[new],
                   np.bincount(key, minlength=distinct.size)[new])
        if before:
            was &= before.has(h)
        at = np.full(at.size, -1, np.int64)
        at[place] = np.where(now.has(h)[key], key, -1)


def _count(docs: DataFrame, longest: int, now, before, words_too: bool, min_count: int, shares: int, name: str) -> DataFrame:
    """``(lang, phrase, k, n)`` of what a pass counts, from ``min_count`` on; where
    words are counted too, the row with k = 0 holds a language's words in all.

    A tile's counts travel in packed rows, one per share of the phrases (by their
    hash); a share's rows are added up by the phrases themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt, old = now.value if now else None, before.value if before else None
        for b in batches:
            for lang in pc.unique(b.column(0)).to_pylist():
                data, off = text_bytes(b.column(1).filter(pc.equal(b.column(0), lang)))
                cut = BREAK[data]
                inner = off[1:-1]
                cut[inner[inner > 0] - 1] = True
                for lo, hi in tiles(cut, TILE):
                    edges = off[np.searchsorted(off, lo):np.searchsorted(off, hi)] - lo
                    for k, phrase, h, n in _tile_counts(data[lo:hi], edges, lang.encode(), longest, filt, old, words_too):
                        if k == 1:
                            yield _packed(lang, pa.array([b""]), np.zeros(1, np.uint64), np.array([n.sum()]), shares)
                        yield _packed(lang, phrase, h, n, shares)
    rows = docs.select("lang", "text").mapInArrow(run, "lang string, share int, data binary, size binary, n binary")

    def add(group: pa.Table) -> pa.Table:
        size = np.frombuffer(b"".join(group["size"].to_pylist()), "<i4")
        n = np.frombuffer(b"".join(group["n"].to_pylist()), "<i8")
        off = np.zeros(size.size + 1, np.int32)
        np.cumsum(size, out=off[1:])
        data = b"".join(group["data"].to_pylist())
        coded = pa.Array.from_buffers(pa.string(), size.size, [None, pa.py_buffer(off), pa.py_buffer(data)]).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        total = np.add.reduceat(n[order], np.searchsorted(code[order], np.arange(len(coded.dictionary))))
        keep = (total >= min_count) | (pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) == 0)
        phrase = coded.dictionary.filter(pa.array(keep))
        k = pc.if_else(pc.equal(phrase, ""), 0, pc.add(pc.count_substring(phrase, " "), 1)).cast(pa.int8())
        return pa.table([pa.repeat(group["lang"][0], len(phrase)), phrase, k, pa.array(total[keep])], ["lang", "phrase", "k", "n"])
    return saved(rows.groupBy("lang", "share").applyInArrow(add, "lang string, phrase string, k tinyint, n long"), name)


def _packed(lang: str, phrases: pa.Array, h: np.ndarray, n: np.ndarray, shares: int) -> pa.RecordBatch:
    """Phrases with their counts, one row per share: their bytes, sizes (i32) and counts (i64)."""
    share = (h >> np.uint64(32)).astype(np.int64) % shares
    order = np.argsort(share, kind="stable")
    share = share[order]
    cut = np.r_[0, np.flatnonzero(np.diff(share)) + 1, share.size].tolist()
    data, off = text_bytes(phrases.take(pa.array(order)))
    size, n = np.diff(off).astype("<i4"), n[order].astype("<i8")
    spans = list(zip(cut[:-1], cut[1:], strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.repeat(lang, len(spans)), pa.array(share[cut[:-1]].astype(np.int32)),
         pa.array([data[off[a]:off[b]].tobytes() for a, b in spans], pa.binary()),
         pa.array([size[a:b].tobytes() for a, b in spans], pa.binary()),
         pa.array([n[a:b].tobytes() for a, b in spans], pa.binary())], ["lang", "share", "data", "size", "n"])


def _grown(old, phrases: DataFrame, longest: int, bits: int):
    """The broadcast bitmap ``old`` (or an empty one) with the phrases that can have
    a longer one; ``old`` itself, if it has them all. At most ``bits / 64`` rows of
    two numbers come to the driver, however many phrases there are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang in pc.unique(b.column(0)).to_pylist():
                at = phrase_hashes(lang, b.column(1).filter(pc.equal(b.column(0), lang))) & np.uint64(bits - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((at >> np.uint64(6)).astype(np.int64)),
                     pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["slot", "mask"])
    rows = (phrases.where((F.col("k") >= 1) & (F.col("k") < longest)).select("lang", "phrase")
            .mapInArrow(run, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow())
    made = Bitmap(bits)
    made.data[rows["slot"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    if old:
        made.data |= old.value.data
        if (made.data == old.value.data).all():
            return old
    return phrases.sparkSession.sparkContext.broadcast(made)


def frequent_phrases(docs: DataFrame, longest: int = 4, min_count: int = 30, sample: float = 0.125,
                     sample_count: int = 2, filter_bits: int = FILTER_BITS, id_col: str = "doc_id",
                     text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, phrase, k, n)``: every phrase of 1 to ``longest`` words that occurs
    ``min_count`` times or more in a language, with its exact count; the row with
    k = 0 and an empty phrase holds the language's words in all.

    ``sample`` is the share of documents (by a hash of their id) that is mined first
    with the threshold ``sample_count``; it has no influence on the result."""
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(id_col).alias("id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shares, fewer = (max(16, int(-(-x // SHARE_BYTES))) for x in (total, total * sample))
    part = src.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(sample * (1 << 20)))
    past = now = None
    for level in range(1, longest):
        got = _count(part, level, now, past, level == 1, sample_count, fewer, f"phrases-sample-{level}")
        past, now = now, _grown(now, got, longest, filter_bits)
    found, past = _count(src, longest, now, None, True, min_count, shares, "phrases-full"), now
    while longest > 1:
        # Frequent phrases outside the bitmap are the border's failures.
        now = _grown(past, found, longest, filter_bits)
        if now is past:
            break
        found = found.unionByName(_count(src, longest, now, past, False, min_count, shares, "phrases-closing"))
        past = now
    return found


# ------------------------------------------------------------------ scores

def _words(c: str, begin, n):
    return F.array_join(F.slice(F.split(c, " "), begin, n), " ")


def collocations(docs: DataFrame, longest: int = 4, min_count: int = 30, inside_percent: int = 80, top: int = 2000,
                 **options) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language by how firmly
    they stick together: ``(lang, rank, phrase, a, l, r, n, score)``.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words are runs of
    other characters than space and tab. ``a`` is the phrase's count; a cut after
    its first words has the counts ``l`` and ``r`` of both parts and the score
    ``floor(2000000 a / (l + r))``; the lowest cut counts (the first of equal ones).
    A phrase that stands inside a longer frequent one whose count is
    ``inside_percent`` of its own or more is left out. Order: score, then ``a``
    descending, then the phrase's bytes. ``n`` is the language's number of words.

    A null language is ``und``, a null or empty text has no words, repeated rows
    count each time, an empty table gives no rows; ids only choose the sample and
    other columns are not read. Texts of any length (tiles end between pieces; one
    piece is held whole)."""
    f = frequent_phrases(docs, longest, min_count, **options)
    phrases = f.where(F.col("k") >= 2).select("lang", "phrase", F.col("k").cast("int").alias("k"), F.col("n").alias("a"))
    # Both parts of every cut, each looked up once among the frequent phrases.
    cuts = phrases.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    parts = cuts.select("lang", "phrase", "a", "cut", F.inline(F.array(
        F.struct(F.lit(True).alias("first"), _words("phrase", F.lit(1), F.col("cut")).alias("part")),
        F.struct(F.lit(False).alias("first"), _words("phrase", F.col("cut") + 1, F.col("k") - F.col("cut")).alias("part")))))
    table = f.where((F.col("k") >= 1) & (F.col("k") < longest)).select("lang", F.col("phrase").alias("part"), "n")
    looked = parts.join(table, ["lang", "part"]).select("lang", "phrase", "a", "cut", "first", "n", F.lit(None).cast("long").alias("longer"))
    # What lies inside a phrase, with the phrase's count.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("k") - m + 1), lambda b: F.struct(b.alias("b"), m.alias("m")))))
    inner = (phrases.where(F.col("k") >= 3).select("phrase", "lang", "a", F.inline(spans))
             .select("lang", _words("phrase", F.col("b"), F.col("m")).alias("phrase"), F.lit(None).cast("long").alias("a"),
                     F.lit(None).cast("int").alias("cut"), F.lit(None).cast("boolean").alias("first"),
                     F.lit(None).cast("long").alias("n"), F.col("a").alias("longer")))
    one = [F.max(F.when((F.col("cut") == c) & (F.col("first") == side), F.col("n"))).alias(f"{'l' if side else 'r'}{c}")
           for c in range(1, longest) for side in (True, False)]
    merged = looked.unionByName(inner).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *one)
    wide = [F.when(F.col(f"l{c}").isNotNull(), F.struct(
        F.expr(f"(cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0))) div (cast(l{c} as decimal(20,0)) + cast(r{c} as decimal(20,0)))")
        .alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r"))) for c in range(1, longest)]
    least = F.array_min(F.filter(F.array(*wide), lambda x: x.isNotNull()))
    inside = F.coalesce(F.expr("cast(100 as decimal(4,0)) * cast(longer as decimal(20,0))")
                        >= F.expr(f"cast({int(inside_percent)} as decimal(4,0)) * cast(a as decimal(20,0))"), F.lit(False))
    scored = (merged.where(F.col("a").isNotNull() & ~inside).select("lang", "phrase", "a", least.alias("x"))
              .select("lang", "phrase", "a", "x.l", "x.r", "x.score", F.pmod(F.xxhash64("phrase"), F.lit(256)).alias("salt")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", "salt"], ["lang"]):      # winners of 256 shares of a language, then of the language
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    total = f.where(F.col("k") == 0).groupBy("lang").agg(F.sum("n").alias("n"))
    return scored.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
