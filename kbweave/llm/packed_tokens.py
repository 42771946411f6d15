"""Token ids in binary files of fixed-width packed integers.

A corpus folder holds one file per range of document ids, in order. Every id takes
the fewest bits that hold the vocabulary's largest id. File layout (little-endian):

* blocks of ``block`` ids each (the last one may be shorter), bit-packed from the
  lowest bit on, each padded to whole bytes and ended by one line feed;
* a footer: byte offset of every block (u64), then per document its id (i64), a
  null flag (u8) and its number of ids (u64);
* a trailer of fixed size: footer bytes, documents, ids (u64 each), file number,
  block (u32 each), bits (u16), magic, and one line feed.

Block ``i`` holds ids ``i * block ..``, so any id range is read from the blocks that
hold it, and a block is unpacked by numpy at once. Files are written by Spark's
file writer (each block and the footer is one binary "line"), so they are
committed with the job, on any file system, and a lost executor leaves none behind.

The tokenizers library encodes byte-level BPE texts by independent pieces. A single
space between two visible characters (ASCII, or U+00C0 to U+07FF) always begins a new
piece, and so does one of ``,.;:!?`` behind a letter of ASCII or up to U+00FF. Each distinct stretch between such places
is encoded once per tile of text, short ones once per worker as long as they fit
a bounded table, and its ids are put in all its places. Other tokenizers get
whole texts.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbweave.llm.common import saved, text_bytes

MAGIC = b"KBWTOK01"
TRAILER = struct.Struct("<QQQIIH8s")
BLOCK = 1 << 16                  # ids in a block
TILE = 8 << 20                   # bytes of text whose stretches are encoded once
CALL = 16_384                    # texts handed to the tokenizer at once
KNOWN = 1 << 20                  # stretches that a worker remembers, of up to KNOWN_BYTES bytes
KNOWN_BYTES = 48
STOPS = b",.;:!?"
_STOP = np.isin(np.arange(256), list(STOPS))


# ------------------------------------------------------------------ packing

def bits_of(vocabulary: int) -> int:
    """Fewest bits for ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (below ``2**bits``) packed from the lowest bit on, padded to whole bytes."""
    raw = np.ascontiguousarray(ids, "<u4")
    if raw.size and bits < 32 and int(raw.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    each = np.unpackbits(raw.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each, bitorder="little").tobytes()


def unpack(data, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = each
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


class PackedFile:
    """Reads the bytes of one file: documents, and ids from any place on."""

    def __init__(self, data):
        self.data = memoryview(data)
        at = len(self.data) - 1 - TRAILER.size
        if at < 0:
            raise ValueError("not a packed token file")
        foot, docs, self.n_ids, self.number, self.block, self.bits, magic = TRAILER.unpack(self.data[at:at + TRAILER.size])
        if magic != MAGIC or foot > at:
            raise ValueError("not a packed token file")
        blocks = -(-self.n_ids // self.block)
        at -= foot
        self.offsets = np.frombuffer(self.data, "<u8", blocks, at)
        self.doc_ids = np.frombuffer(self.data, "<i8", docs, at + 8 * blocks)
        self.null = np.frombuffer(self.data, np.uint8, docs, at + 8 * (blocks + docs)).astype(bool)
        self.sizes = np.frombuffer(self.data, "<u8", docs, at + 8 * (blocks + docs) + docs).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the file on, reading only their blocks."""
        if start < 0 or n < 0 or start + n > self.n_ids:
            raise IndexError("ids outside the file")
        parts = []
        for b in range(start // self.block, -(-(start + n) // self.block)):
            size = min(self.block, self.n_ids - b * self.block)
            at = int(self.offsets[b])
            got = unpack(self.data[at:at + (size * self.bits + 7) // 8], size, self.bits)
            parts.append(got[max(0, start - b * self.block):start + n - b * self.block])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.sizes[i]))


class _Writer:
    """Ids and documents of one file in, its lines (blocks, then the footer) out."""

    def __init__(self, number: int, bits: int, block: int):
        self.number, self.bits, self.block = number, bits, block
        self.left, self.at, self.n_ids = np.zeros(0, np.uint32), 0, 0
        self.offsets, self.docs = [], []

    def add(self, doc_ids: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
        self.docs.append((doc_ids.fill_null(0).to_numpy(zero_copy_only=False), doc_ids.is_null().to_numpy(zero_copy_only=False), sizes))
        ids = np.concatenate([self.left, ids]) if self.left.size else ids
        full = ids.size // self.block * self.block
        for lo in range(0, full, self.block):
            yield self._block(ids[lo:lo + self.block])
        self.left = ids[full:].copy()

    def _block(self, ids: np.ndarray) -> bytes:
        out = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.at += len(out) + 1
        self.n_ids += ids.size
        return out

    def end(self) -> Iterator[bytes]:
        if self.left.size:
            yield self._block(self.left)
        ids, null, sizes = (np.concatenate(x) for x in zip(*self.docs, strict=True))
        foot = (np.array(self.offsets, "<u8").tobytes() + ids.astype("<i8").tobytes()
                + null.astype(np.uint8).tobytes() + sizes.astype("<u8").tobytes())
        yield foot + TRAILER.pack(len(foot), ids.size, self.n_ids, self.number, self.block, self.bits, MAGIC)


# ------------------------------------------------------------------ encoding

class Encoder:
    def __init__(self, data: bytes, end: int):
        import os

        from tokenizers import Tokenizer, pre_tokenizers
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # Spark runs one task per core
        self.tok = Tokenizer.from_str(data.decode("utf-8"))
        self.end = end
        self.vocabulary = max(self.tok.get_vocab(with_added_tokens=True).values()) + 1
        if not 0 <= end < self.vocabulary:
            raise ValueError("the end id must be in the vocabulary")
        spec = json.loads(data)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.by_piece = (spec["model"].get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                         and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
                         and not spec["model"].get("dropout")
                         and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or not set(a["content"].encode()).isdisjoint(b" " + STOPS)
                                 for a in added))
        spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {}
        for c in (" ", *map(chr, range(0x80, 0x800))):
            self.alphabet.update(zip(c.encode(), spelt.pre_tokenize_str(c)[0][0], strict=True))
        self.known, self.ids, self.ends = pa.array([], pa.binary()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of each text's."""
        parts, sizes = [], np.zeros(len(texts), np.int64)
        for lo in range(0, len(texts), CALL):               # the library's result objects are far larger than the ids
            got = [e.ids for e in self.tok.encode_batch_fast(texts[lo:lo + CALL], add_special_tokens=False)]
            sizes[lo:lo + len(got)] = list(map(len, got))
            parts.append(np.fromiter(chain.from_iterable(got), np.uint32))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), sizes

    def _pieces(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_ids``, of stretches. One of letters alone (and a space before them) is
        one piece, which the library's model takes as it is, spelt in its byte alphabet."""
        word, alphabet = self.tok.model.tokenize, self.alphabet
        got: list = [None] * len(stretches)
        rest = []
        for i, x in enumerate(stretches):
            letters = x[1:] if x[0] == " " else x
            if letters.isalpha() and (letters.isascii() or max(letters) < "\u0800"):
                got[i] = [t.id for t in word(x.encode().decode("latin-1").translate(alphabet))]
            else:
                rest.append(i)
        for lo in range(0, len(rest), CALL):                # the library's result objects are far larger than the ids
            some = rest[lo:lo + CALL]
            for i, e in zip(some, self.tok.encode_batch_fast([stretches[i] for i in some], add_special_tokens=False), strict=True):
                got[i] = e.ids
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    def _stretches(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, begin, size)``: the ids of stretch ``i`` are ``ids[begin[i]:][:size[i]]``."""
        at = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(at < 0)
        words = distinct.take(pa.array(new))
        ids, sizes = self._pieces([x.decode("utf-8") for x in words.to_pylist()])
        begin, size = self.ends[at], np.diff(self.ends, append=0)[at]
        begin[new], size[new] = self.ids.size + np.cumsum(sizes) - sizes, sizes
        both = np.concatenate([self.ids, ids])
        short = pc.less_equal(pc.binary_length(words), KNOWN_BYTES)
        if len(self.known) + len(words) > KNOWN:
            self.known, self.ids, self.ends = self.known[:0], self.ids[:0], self.ends[:1]
        if len(self.known) + len(words) <= KNOWN:
            keep = short.to_numpy(zero_copy_only=False)
            self.known = pa.concat_arrays([self.known, words.filter(short)])
            self.ids = np.concatenate([self.ids, ids[np.repeat(keep, sizes)]])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes[keep])])
        return both, begin, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by the end id, and the number of each text's."""
        data, off = text_bytes(texts)
        first = off[:-1]
        if not self.by_piece:
            ids, sizes = self._ids([bytes(data[a:b]).decode("utf-8") for a, b in zip(off[:-1], off[1:], strict=True)])
        else:
            seen = (data > 0x20) & (data < 0x7F)
            # Characters of two bytes from U+00C0 to U+07FF are no white space either.
            lead, tail = (data >= 0xC3) & (data <= 0xDF), np.zeros(data.size, bool)
            tail[1:] = lead[:-1]
            cut = np.zeros(data.size + 1, bool)
            if data.size > 2:
                cut[1:-2] = (data[1:-1] == 0x20) & (seen | tail)[:-2] & (seen | lead)[2:]
                low = data | 0x20
                letter = (low >= 0x61) & (low <= 0x7A)
                letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
                cut[1:-1] |= _STOP[data[1:]] & letter[:-1]
            cut[first] = True
            start = np.flatnonzero(cut[:data.size])
            ends = np.r_[start, data.size].astype(np.int64)
            if data.size < 1 << 31:
                parts = pa.Array.from_buffers(pa.binary(), start.size, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            else:
                parts = pa.Array.from_buffers(pa.large_binary(), start.size, [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())
            coded = parts.dictionary_encode()
            stock, begin, size = self._stretches(coded.dictionary)
            code = coded.indices.to_numpy(zero_copy_only=False)
            each = size[code]
            place = np.cumsum(each) - each
            at = np.repeat((begin[code] - place).astype(np.int32), each)      # a tile's ids are fewer than 2**31
            at += np.arange(at.size, dtype=np.int32)
            ids = stock[at]
            total = np.r_[0, np.cumsum(each)]
            sizes = np.diff(total[np.searchsorted(start, off)]) if start.size else np.zeros(len(texts), np.int64)
        ends = np.cumsum(sizes)
        return np.insert(ids, ends, np.uint32(self.end)), sizes + 1


@lru_cache(maxsize=2)
def _encoder(data: bytes, end: int) -> Encoder:
    return Encoder(data, end)


def _slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``size`` bytes."""
    _, off = text_bytes(texts)
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


# ------------------------------------------------------------------ Spark

def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text",
                 file_bytes: int = 16 << 20, block: int = BLOCK) -> None:
    """Write the ids of every whole text, in ascending order of ``id_col`` (an
    integer column), to packed files of about ``file_bytes`` of text under ``path``.

    Each text's ids are followed by ``end``; a null or empty text is the end id
    alone. Null ids come first; equal ids go by text hash, equal rows in any order,
    and are spread over files like any others. An empty table writes no file with
    content. Other columns are not read. A task holds one tile of text and a
    block of ids, and a file's document index."""
    with open(tokenizer, "rb") as f:
        raw = f.read()                                    # a fixed, small file
    bits = bits_of(_encoder(raw, end).vocabulary)
    data = docs.sparkSession.sparkContext.broadcast(raw)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    total = src.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    keys = ["id", "h", "m"]
    dealt = (src.withColumn("h", F.xxhash64("t")).withColumn("m", F.monotonically_increasing_id())
             .repartitionByRange(max(1, -(-total // file_bytes)), *keys).sortWithinPartitions(*keys)
             .select("id", "t", F.spark_partition_id().alias("p")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = _encoder(data.value, end), None

        def line(x: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], ["value"])
        for b in batches:
            if not b.num_rows:
                continue
            out = out or _Writer(b.column(2)[0].as_py(), bits, block)
            for lo, hi in _slices(b.column(1), TILE):
                ids, sizes = encoder.encode(b.column(1).slice(lo, hi - lo))
                for x in out.add(b.column(0).slice(lo, hi - lo), sizes, ids):
                    yield line(x)
        if out:
            for x in out.end():
                yield line(x)
    # The text writer puts a string's bytes down as they are, and one line feed.
    dealt.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, read from the files: ``(file, place, doc_id, start,
    n_tokens, ids_crc32)``. ``start`` counts the ids of all documents before it
    in the corpus, ``ids_crc32`` is taken over its ids as unsigned 32-bit
    little-endian integers. The order of documents is (file, place)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                f = PackedFile(x.as_buffer())
                crc = np.zeros(f.sizes.size, np.int64)
                lo = 0
                while lo < f.sizes.size:                   # runs of documents of about 16 blocks of ids
                    hi = max(lo + 1, int(np.searchsorted(f.starts, f.starts[lo] + 16 * f.block, "left")))
                    base = int(f.starts[lo])
                    got = f.ids(base, int(f.starts[hi - 1] + f.sizes[hi - 1]) - base)
                    raw = memoryview(got.tobytes())
                    for i in range(lo, hi):
                        at = 4 * (int(f.starts[i]) - base)
                        crc[i] = zlib.crc32(raw[at:at + 4 * int(f.sizes[i])])
                    lo = hi
                n = f.sizes.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, f.number, np.int64)), pa.array(np.arange(n)), pa.array(f.doc_ids, mask=f.null),
                     pa.array(f.starts), pa.array(f.sizes), pa.array(crc)], ["file", "place", "doc_id", "at", "n_tokens", "ids_crc32"])
    rows = saved(_files(spark, path).mapInArrow(
        run, "file long, place long, doc_id long, at long, n_tokens long, ids_crc32 long"), "token-index")
    # Ids before each file: sums per file, then per group of files, so no window holds more than one group or one row a group.
    group = F.shiftright("file", 12)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("g", group)
    groups = files.groupBy("g").agg(F.sum("n").alias("gn"))
    groups = groups.select("g", (F.sum("gn").over(Window.orderBy("g")) - F.col("gn")).alias("g0"))
    files = files.withColumn("f0", F.sum("n").over(Window.partitionBy("g").orderBy("file")) - F.col("n"))
    base = files.join(groups, "g").select("file", (F.col("f0") + F.col("g0")).alias("base"))
    return rows.join(base, "file").select("file", "place", "doc_id", (F.col("base") + F.col("at")).alias("start"),
                                          "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)`` of all documents, or of the given ones (a short
    list), of which only the blocks that hold them are unpacked."""
    wanted = None if doc_ids is None else np.array(sorted(doc_ids), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                f = PackedFile(x.as_buffer())
                take = np.arange(f.sizes.size) if wanted is None else np.flatnonzero(np.isin(f.doc_ids, wanted) & ~f.null)
                for i in take:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([None if f.null[i] else int(f.doc_ids[i])], pa.int64()),
                         pa.array([f.document(int(i)).astype(np.int32)], pa.list_(pa.int32()))], ["doc_id", "ids"])
    return _files(spark, path).mapInArrow(run, "doc_id long, ids array<int>")
