"""SentencePiece encoding and decoding on the tokenizers library.

The model file (a protobuf) is parsed here; its normaliser, the metaspace marker
``▁`` for spaces, the pieces with their scores and byte fallback are rebuilt as a
``tokenizers`` pipeline: a unigram model keeps its scores, a BPE model gets its
merges from them (a piece's two halves merge in the order of the piece's score).

Texts are encoded in multithreaded batches by that pipeline, whose ids are decoded
again by its decoder and compared with the text; the sentencepiece library encodes
the same texts, and where its ids differ they are given instead and counted.

A BPE model whose pieces hold the marker only in front joins nothing across a
single space between two visible characters. Then a text is the sequence of its
stretches between such spaces: each distinct stretch is encoded, compared and
decoded once (short ones once per worker, in a bounded table), and a text's ids and
verdicts are those of its stretches. Other models get whole texts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbweave.llm.common import give_back, text_bytes

MARK = "▁"
NORMAL, CONTROL, USER_DEFINED, BYTE = 1, 3, 4, 6
UNIGRAM, BPE = 1, 2
TILE = 1 << 20                    # bytes of text whose stretches are encoded once
CALL = 2_048                      # texts handed to the libraries at once
KNOWN, KNOWN_BYTES = 1 << 18, 48  # stretches that a worker remembers, and their size at most


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(field number, value)`` of a protobuf message."""
    def varint(i):
        n = shift = 0
        while True:
            n |= (buf[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if buf[i - 1] < 128:
                return n, i
    i = 0
    while i < len(buf):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            val, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            val, i = buf[i:i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            val, i = buf[i:i + n], i + n
        yield key >> 3, val


class Model:
    """What the protobuf says; numbers are field numbers of its public schema."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unk, self.suffix = UNIGRAM, False, 0, False
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape = b"", True, True, True
        for f, val in _fields(data):
            if f == 1:
                d = dict(_fields(val))
                self.pieces.append((d[1].decode("utf-8"), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
            elif f == 2:
                d = dict(_fields(val))
                self.kind, self.byte_fallback = d.get(3, UNIGRAM), bool(d.get(35, 0))
                self.unk, self.suffix = d.get(40, 0), bool(d.get(24, 0))
            elif f == 3:
                d = dict(_fields(val))
                self.charsmap = d.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(d.get(k, 1)) for k in (3, 4, 5))
        if self.kind not in (UNIGRAM, BPE) or self.suffix or not self.escape:
            raise ValueError("only unigram and BPE models with the marker before words are supported")


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """BPE merges in order: by the merged piece's score, then by the halves' ids."""
    known = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for p, score, kind in pieces:
        if kind == NORMAL and len(p) > 1:
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                if a in known and b in known:
                    found.append((-score, known[a], known[b], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


class Codec:
    def __init__(self, data: bytes, threads: int = 2):
        import os

        import sentencepiece
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers
        # Read when the library first runs a batch in this worker process.
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        self.threads, m = threads, Model(data)
        self.model = m
        # Control pieces never match text: in the vocabulary a noncharacter stands before them.
        names = ["\uffff" + p if kind == CONTROL else p for p, _, kind in m.pieces]
        self.control = {i for i, (*_, kind) in enumerate(m.pieces) if kind == CONTROL}
        if m.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, (_, s, _) in zip(names, m.pieces, strict=True)], m.unk, m.byte_fallback)
        else:
            core = models.BPE({p: i for i, p in enumerate(names)}, merges(m.pieces), unk_token=names[m.unk],
                              fuse_unk=True, byte_fallback=m.byte_fallback)
        steps = []
        if m.charsmap:
            steps.append(normalizers.Precompiled(m.charsmap))
        if m.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(True, True)]
        if m.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        steps.append(normalizers.Replace(" ", MARK))
        self.whole = Tokenizer(core)
        self.whole.normalizer = normalizers.Sequence(steps)
        ends = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        self.whole.decoder = decoders.Sequence(ends + ([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []))
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.by_stretch = (m.kind == BPE and m.dummy_prefix
                           and not any(MARK in p.lstrip(MARK) for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED)))
        self._forget()

    def encode(self, texts: list[str]) -> list[tuple[list[int], bool, bool]]:
        """``(ids, differed from the sentencepiece library, decodes to the text)`` of each text."""
        return list(zip(*self._compared(texts), strict=True))

    def _compared(self, texts: list[str]) -> tuple[list[list[int]], list[bool], list[bool]]:
        """The same as three lists; a batch without a difference is compared at once."""
        own = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        want = self.reference.encode(texts, num_threads=self.threads)
        differ = [False] * len(own) if own == want else [o != w for o, w in zip(own, want, strict=True)]
        ids = own if own == want else want                     # equal where they do not differ
        back = self.decode(ids)
        return ids, differ, [True] * len(back) if back == texts else [d == t for d, t in zip(back, texts, strict=True)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids in order, and for each text (null: empty) its number of ids, whether the
        libraries differed on it, and whether the ids decode to it."""
        data, off = text_bytes(texts)
        cut = self._cuts(data, off)
        kept = np.r_[0, np.cumsum(~cut)]                       # the space between two stretches belongs to none
        full = np.diff(off) > 0
        start = np.sort(np.r_[off[:-1][full], np.flatnonzero(cut) + 1])
        row = np.searchsorted(off, start, "right") - 1
        parts = pa.Array.from_buffers(pa.large_string(), start.size, [
            None, pa.py_buffer(np.append(kept[start], kept[-1])), pa.py_buffer(data[~cut])]).dictionary_encode()
        stock, begin, size, differ, same = self._stretches(parts.dictionary)
        code = parts.indices.to_numpy(zero_copy_only=False)
        each = size[code]
        place = np.cumsum(each) - each
        at = np.repeat(begin[code] - place, each) + np.arange(int(each.sum()))
        n = len(texts)
        return (stock[at], np.bincount(row, weights=each, minlength=n).astype(np.int64),
                np.bincount(row, weights=differ[code], minlength=n) > 0, np.bincount(row, weights=~same[code], minlength=n) == 0)

    def _cuts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Single spaces between two visible characters: of ASCII, or (without a
        normaliser's table) from U+00C0 to U+07FF."""
        cut = np.zeros(data.size, bool)
        if not self.by_stretch or data.size < 3:
            return cut
        seen = (data > 0x20) & (data < 0x7F)
        before, after = seen.copy(), seen.copy()
        if not self.model.charsmap:
            lead = (data >= 0xC3) & (data <= 0xDF)
            before[1:] |= lead[:-1]
            after |= lead
        cut[1:-1] = (data[1:-1] == 0x20) & before[:-2] & after[2:]
        inner = off[(off > 0) & (off < data.size)]
        cut[inner] = False                                     # a text's first byte, or its last
        cut[inner - 1] = False
        return cut

    def _stretches(self, distinct: pa.Array):
        """``(ids, begin, size, differed, same)``: the ids of stretch ``i`` are ``ids[begin[i]:][:size[i]]``."""
        at = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(at < 0)
        self.met[at[at >= 0]] = True
        words, got = distinct.take(pa.array(new)), []
        texts = words.to_pylist()
        for lo in range(0, len(texts), CALL):                  # the libraries' result objects are far larger than the ids
            some, *said = self._compared(texts[lo:lo + CALL])
            got.append((np.fromiter(chain.from_iterable(some), np.int32), np.fromiter(map(len, some), np.int64, len(some)), np.array(said, bool).T))
        ids, size_new = (np.concatenate([np.zeros(0, kind), *(g[i] for g in got)]) for i, kind in enumerate((np.int32, np.int64)))
        flags = np.concatenate([np.zeros((0, 2), bool), *(g[2] for g in got)])
        begin, size, said = self.ends[at], np.diff(self.ends, append=0)[at], np.zeros((len(at), 2), bool)
        said[at >= 0] = self.flags[at[at >= 0]]
        begin[new], size[new], said[new] = self.ids.size + np.cumsum(size_new) - size_new, size_new, flags
        stock = np.concatenate([self.ids, ids])
        if len(self.known) + len(words) > KNOWN:
            self._forget(but=self.met)
        short = pc.less_equal(pc.binary_length(words), KNOWN_BYTES)
        keep = short.to_numpy(zero_copy_only=False).astype(bool)
        if len(self.known) + len(words) <= KNOWN:
            self.known = pa.concat_arrays([self.known, words.filter(short)])
            self.ids = np.concatenate([self.ids, ids[np.repeat(keep, size_new)]])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size_new[keep])])
            self.flags = np.concatenate([self.flags, flags[keep]])
            self.met = np.r_[self.met, np.zeros(int(keep.sum()), bool)]
        return stock, begin, size, said[:, 0], said[:, 1]

    def _forget(self, but: np.ndarray | None = None) -> None:
        """Empty the table, but for the stretches told (those met again since it was last cleared)."""
        if but is None:
            self.known, self.ids = pa.array([], pa.large_string()), np.zeros(0, np.int32)
            self.ends, self.flags = np.zeros(1, np.int64), np.zeros((0, 2), bool)
        else:
            size = np.diff(self.ends)
            self.known, self.ids = self.known.filter(pa.array(but)), self.ids[np.repeat(but, size)]
            self.ends, self.flags = np.r_[0, np.cumsum(size[but])], self.flags[but]
        self.met = np.zeros(len(self.known), bool)

    def decode(self, ids: list[list[int]]) -> list[str]:
        if not self.control.isdisjoint(chain.from_iterable(ids)):
            ids = [[i for i in x if i not in self.control] for x in ids]
        return self.whole.decode_batch(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def _codec(data: bytes, threads: int) -> Codec:
    return Codec(data, threads)


def read_model(path: str) -> bytes:
    """The model file's bytes, read once on the driver (a fixed, small file)."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", threads: int = 2) -> DataFrame:
    """``docs`` with its text replaced by ``ids_col array<int>``, ``n_tokens``,
    ``mended`` (the backend differed from the sentencepiece library, whose ids are
    then given) and ``round_trip`` (the ids decode to the very text).

    Whole texts; a null or empty text has no ids. All other columns and rows
    stay; columns of the four names are replaced. An empty table stays empty."""
    data = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    added = [ids_col, "n_tokens", "mended", "round_trip"]
    keep = [c for c in docs.columns if c not in added and c != text_col]
    src = docs.select(*keep, F.col(text_col).cast("string").alias(text_col))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[:len(keep)])
    schema = (fields + ", " if fields else "") + f"`{ids_col}` array<int>, n_tokens long, mended boolean, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value, threads)
        for b in batches:
            col = b.column(len(keep))
            _, off = text_bytes(col)
            at = 0
            while at < b.num_rows:
                to = min(max(at + 1, int(np.searchsorted(off, off[at] + TILE, "right")) - 1), b.num_rows)
                part = b.slice(at, to - at)
                ids, sizes, differ, same = codec.encode_column(col.slice(at, to - at))
                at = to
                ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(keep)], pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)),
                     pa.array(sizes), pa.array(differ), pa.array(same)], [*keep, *added])
                del part, ids, sizes, differ, same
                give_back()                            # the libraries' objects of a tile, before the next
    return src.mapInArrow(run, schema)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text", threads: int = 2) -> DataFrame:
    """``rows`` with ``ids_col`` replaced by its text. Null ids give null; ids
    outside the vocabulary are skipped; other columns stay."""
    data = rows.sparkSession.sparkContext.broadcast(read_model(model_path))

    @F.pandas_udf("string")
    def text_of(ids):
        import pandas as pd
        codec = _codec(data.value, threads)
        got = codec.decode([[] if x is None else [int(i) for i in x] for x in ids])
        return pd.Series([None if x is None else g for x, g in zip(ids, got, strict=True)])
    return rows.select(*[c for c in rows.columns if c not in (ids_col, text_col)], text_of(ids_col).alias(text_col))
