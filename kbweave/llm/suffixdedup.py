"""Repeated byte strings, removed by blockwise suffix sorting with a difference cover.

Text is packed into compressed blocks, a table bucketed by block number, so that
what is found out about a block comes back to it without moving the text. Three
rounds each send fixed-size keys of some suffixes to buckets; one task sorts one
bucket at a time, and every block gets back two bits for each key it sent: does
the key occur twice or more, and is this its first place.

A. Cover samples. A set of residues modulo 133 in which every difference occurs
   (a perfect difference cover, 12 of 133) picks the sample suffixes. Two equal
   200-byte strings hold equal 68-byte strings at a common sample place, so only
   suffixes near a repeated sample go on. This ranks samples by their bucket's
   sort and bounds all later work by what repeats.
B. Long ties. The remaining suffixes are cut into pieces at places chosen by
   content; a piece with the 199 bytes after it is one key. Where the key repeats,
   all suffixes of the piece tie for their whole length with another piece's.
C. Suffixes, truncated to the match length, of the pieces that do not repeat and
   of one piece of each kind that does.

Keys are 64-bit hashes of the strings (32 bits and the bucket in round A, where a
false tie only makes a suffix go on).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbweave.config import scratch_path
from kbweave.llm.common import saved, shuffle_n, text_bytes
from kbweave.llm.textvec import Prefix, covered

# A perfect difference cover, every residue is a difference of two of them.
PERIOD = 133
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
BLOCK = 2 << 20          # text bytes of a block (a longer text is a block of its own)
BUCKET = 32 << 20        # key bytes that one bucket is planned for
PIECE_BITS = 8           # pieces have 2**8 suffixes on average
ANCHOR = 16              # bytes that decide whether a piece starts


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """``docs(id, text)`` packed: block, ids, ends of the texts, compressed bytes."""
    src = docs.withColumn("_part", F.spark_partition_id())
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0

        def out():
            ids = pa.concat_arrays([b.column(0) for b in held])
            texts = pa.concat_arrays([b.column(1).cast(pa.large_string()) for b in held])
            buf, off = text_bytes(texts)
            part = held[0].column(2)[0].as_py()
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 pa.array([off.tobytes()], pa.binary()),
                 pa.array([zstandard.compress(buf.tobytes(), 3)], pa.binary())], ["block", "ids", "off", "blob"])
        for b in batches:
            _, off = text_bytes(b.column(1))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(off, off[at] + max(0, block_bytes - size), "right")) - 1)
                to = min(to, b.num_rows)
                if held and size + off[to] - off[at] > block_bytes:
                    yield out()
                    held, size, number = [], 0, number + 1
                    continue
                held.append(b.slice(at, to - at))
                size += int(off[to] - off[at])
                at = to
        if held:
            yield out()
    return src.select("id", "text", "_part").mapInArrow(run, f"block long, ids array<{id_type}>, off binary, blob binary")


class Block:
    """One block's text, and what the rounds have found out about it."""

    def __init__(self, off: bytes, blob: bytes, match: int):
        self.off = np.frombuffer(off, np.int64)
        self.buf = np.frombuffer(zstandard.decompress(blob), np.uint8)
        self.match = match
        self.prefix = Prefix(self.buf)
        size = np.diff(self.off)
        self.last = np.repeat(self.off[1:], size)          # end of a byte's text
        self.place = np.arange(len(self.buf)) - np.repeat(self.off[:-1], size)

    def samples(self) -> np.ndarray:
        """Sample places with room for a sample string in their text."""
        in_cover = np.zeros(PERIOD, bool)
        in_cover[list(COVER)] = True
        width = self.match - PERIOD + 1
        at = np.flatnonzero(in_cover[self.place % PERIOD])
        return at[at + width <= self.last[at]]

    def keys_a(self) -> np.ndarray:
        s = self.samples()
        return self.prefix(s, s + self.match - PERIOD + 1)

    def live(self, twice: np.ndarray) -> np.ndarray:
        """Suffixes of full length with a repeated sample in their first PERIOD places."""
        s = self.samples()[twice]
        mask = covered(np.maximum(s - PERIOD + 1, 0), s - np.maximum(s - PERIOD + 1, 0) + 1, len(self.buf))
        at = np.flatnonzero(mask)
        return at[at + self.match <= self.last[at]]

    def pieces(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last index into ``live`` of every piece."""
        if not len(live):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = (self.prefix(live, live + ANCHOR) & np.uint64((1 << PIECE_BITS) - 1)) == 0
        start[0] = True
        start[1:] |= (np.diff(live) > 1) | (self.last[live[1:]] != self.last[live[:-1]])
        first = np.flatnonzero(start)
        return first, np.append(first[1:], len(live)) - 1

    def keys_b(self, a: np.ndarray) -> np.ndarray:
        live = self.live(a)
        first, last = self.pieces(live)
        # The length is part of the key: pieces of unequal length never tie.
        n = (live[last] - live[first]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return self.prefix(live[first], live[last] + self.match) ^ n

    def open_suffixes(self, a: np.ndarray, b: np.ndarray, b_first: np.ndarray) -> np.ndarray:
        live = self.live(a)
        first, last = self.pieces(live)
        return live[np.repeat(~b | b_first, last - first + 1)]

    def keys_c(self, a: np.ndarray, b: np.ndarray, b_first: np.ndarray) -> np.ndarray:
        s = self.open_suffixes(a, b, b_first)
        return self.prefix(s, s + self.match)

    def removed(self, a: np.ndarray, b: np.ndarray, b_first: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Mask of the bytes to remove."""
        live = self.live(a)
        first, last = self.pieces(live)
        starts = np.concatenate([live[np.repeat(b, last - first + 1)], self.open_suffixes(a, b, b_first)[c]])
        return covered(starts, np.full(len(starts), self.match), len(self.buf))


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def _bits(said: list, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets' answers ``(bucket, count, twice, first)`` put back in the order of ``keys``."""
    order = np.argsort(_bucket(keys, n), kind="stable")
    twice, first = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    at = 0
    for x in sorted(said or [], key=lambda x: x["bucket"]):
        for name, mask in (("twice", twice), ("first", first)):
            mask[order[at:at + x["n"]]] = np.unpackbits(np.frombuffer(x[name], np.uint8), count=x["n"]).astype(bool)
        at += x["n"]
    if at != len(keys):
        raise ValueError("a block's answers do not fit its keys")
    return twice, first


def _state(row: dict, match: int, n: int) -> tuple[Block, list]:
    """The block and the flags of the rounds so far."""
    blk, flags = Block(row["off"], row["blob"], match), []
    if "a" in row:
        flags.append(_bits(row["a"], blk.keys_a(), n)[0])
    if "b" in row:
        flags.extend(_bits(row["b"], blk.keys_b(flags[0]), n))
    if "c" in row:
        flags.append(_bits(row["c"], blk.keys_c(*flags), n)[0])
    return blk, flags


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {k: b.column(j)[i].as_py() for j, k in enumerate(b.schema.names) if k != "ids"}


_ASK = "bucket long, block long, n long, keys binary"
_SAID = "bucket long, block long, n long, twice binary, first binary"


def _round(known: DataFrame, match: int, n: int, rough: bool) -> DataFrame:
    """Sends the next round's keys to the buckets; one row of answers per block."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            blk, flags = _state(row, match, n)
            keys = (blk.keys_a, blk.keys_b, None, blk.keys_c)[len(flags)](*flags)
            bucket = _bucket(keys, n)
            order = np.argsort(bucket, kind="stable")
            size = np.bincount(bucket, minlength=n)
            sent = keys[order].astype(np.uint32) if rough else keys[order]
            ends = np.concatenate(([0], np.cumsum(size)))
            full = np.flatnonzero(size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(full), pa.array(np.full(len(full), row["block"])), pa.array(size[full]),
                 pa.array([sent[ends[i]:ends[i + 1]].tobytes() for i in full], pa.binary())], ["bucket", "block", "n", "keys"])

    def sort_bucket(table: pa.Table) -> pa.Table:
        raw = table.column("keys").to_pylist()
        keys = np.frombuffer(b"".join(raw), np.uint32 if rough else np.uint64)
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        head = np.concatenate(([True], k[1:] != k[:-1]))[:len(k)]
        again = np.concatenate((~head[1:], [False]))[:len(k)] | ~head
        twice, first = np.zeros(len(k), bool), np.zeros(len(k), bool)
        twice[order], first[order] = again, head
        cuts = np.cumsum(table.column("n").to_numpy())[:-1]
        return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "n": table.column("n"),
                         "twice": pa.array([np.packbits(x).tobytes() for x in np.split(twice, cuts)], pa.binary()),
                         "first": pa.array([np.packbits(x).tobytes() for x in np.split(first, cuts)], pa.binary())})

    said = known.drop("ids").mapInArrow(ask, _ASK).groupBy("bucket").applyInArrow(sort_bucket, _SAID)
    return said.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "twice", "first")).alias("said"))


def repeated_strings(docs: DataFrame, match: int = 200, id_col: str = "doc_id", text_col: str = "text",
                     with_text: bool = False, block_bytes: int = BLOCK) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` per input row, and the
    kept bytes as ``kept binary`` if ``with_text``.

    Every byte covered by a ``match``-byte string that also starts anywhere else
    (other rows or the same, overlaps too) is removed, judged on the input;
    strings never cross rows. Null text is empty. Rows that share an id or text
    are rows like any other, a null id stays; an empty table gives no rows; other
    columns are ignored. ``match`` must be at least 133 + 16."""
    if match < PERIOD + ANCHOR:
        raise ValueError("match is too short for the cover")
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    parts = shuffle_n(spark)
    name = f"suffix_blocks_{uuid.uuid4().hex}"
    (_blocks(src, block_bytes).write.bucketBy(parts, "block").option("path", scratch_path(spark, "suffix-blocks"))
     .option("compression", "none").format("parquet").saveAsTable(name))
    blocks = spark.table(name)
    total = spark.table(name).agg(F.sum(F.length("blob")).alias("n")).first()["n"] or 0
    n = max(parts, min(1 << 20, 4 * int(total) // BUCKET))
    known = blocks
    for said, rough in (("a", True), ("b", False), ("c", False)):
        got = saved(_round(known, match, n, rough), f"suffix-{said}").withColumnRenamed("said", said)
        known = known.join(got.hint("shuffle_hash"), "block", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row in enumerate(_rows([b])):
                blk, flags = _state(row, match, n)
                gone = blk.removed(*flags)
                out = []
                for lo, hi in zip(blk.off[:-1], blk.off[1:], strict=True):
                    g = gone[lo:hi]
                    kept = blk.buf[lo:hi][~g].tobytes()
                    spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(len(g) > 0 and g[0])
                    out.append((int(hi - lo), int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [b.column(b.schema.get_field_index("ids"))[i].values, *(pa.array(c, pa.int64()) for c in cols[:3]),
                     pa.array(cols[3]), pa.array(cols[4], pa.binary())],
                    ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    out = known.mapInArrow(finish, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.withColumnRenamed("id", id_col)
    return out if with_text else out.drop("kept")
