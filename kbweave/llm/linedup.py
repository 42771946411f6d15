r"""Repeated line runs: suffixes of line-ID sequences, prefix doubling, LCP intervals.

A line's ID is a 128-bit hash of its text; a document is the sequence of its IDs.
Suffixes begin at every line and end with their document. The name of the ``2h`` lines
from a place on is made of the names of the ``h`` lines there and ``h`` lines further on,
and the name of any number of lines between ``2h`` and ``4h`` of two overlapping runs of
``2h``; so names come from doubling alone, and equal names are equal runs wherever
they stand. Suffixes that share a name form an interval of the suffix array whose
common prefix has at least that many lines. Sorting is by shuffles on names; no
interval is ever gathered in one task:

1. lines that stand twice or more;
2. doubling inside runs of such lines, until names are unique: for every place the
   largest power of two that an earlier place shares;
3. descent from there to the exact length, four bits a round: which of the next
   lengths does an interval of two or more suffixes have? In an interval only
   its first place goes on below (all others share more with it), and all of
   them go on above; so the places of a round are those of the interval tree's nodes.

What an earlier place shares with a place at most, its longest common prefix with any
of them, is a maximal repeated run; it is deleted at the later place if it reaches the
limits. Each round is a partial aggregate by name (a run that a third of all documents
share is one row a task) and a join of the names that occur twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbweave.llm.common import fresh, give_back, saved

_BITS = 4                         # of a run's length that one round of the descent settles
_STATE = "hits binary, nodes binary"
_DOCS = 256                       # documents worked off at once


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Two-lane 64-bit names of pairs of two-lane names."""
    with np.errstate(over="ignore"):
        x = (a ^ np.uint64(0x9E3779B97F4A7C15 + salt)) * np.uint64(0xFF51AFD7ED558CCD) + b * np.array(
            [0xC4CEB9FE1A85EC53, 0x165667B19E3779F9], np.uint64)
        x ^= x >> np.uint64(29)
        x = (x + x[:, ::-1] * np.uint64(0x2545F4914F6CDD1D)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _levels(ids: np.ndarray, top: int) -> list[np.ndarray]:
    """Names of the runs of 1, 2, 4 ... ``2**top`` lines from each place on (as far as they fit)."""
    out = [ids]
    for k in range(1, top + 1):
        h = 1 << (k - 1)
        if len(ids) < 2 * h:
            break
        out.append(_mix(out[-1][:-h], out[-1][h:], k))
    return out


def _run_ends(repeated: np.ndarray) -> np.ndarray:
    """For each place the end of the run of repeated lines it stands in (itself, if it is none)."""
    n = len(repeated)
    stop = np.where(repeated, n, np.arange(n))
    return np.minimum.accumulate(stop[::-1])[::-1]


class _Lines:
    """The lines of a batch of documents as one sequence, no run of which crosses a
    document's end; ``hits`` (place, lines, later) and ``nodes`` (place, level, lines,
    later) are told by place in the sequence."""

    def __init__(self, ids: list[bytes], hits: list | None, nodes: list | None):
        self.ids = np.frombuffer(b"".join(ids), "<u8").reshape(-1, 2)
        size = np.fromiter((len(x) // 16 for x in ids), np.int64, len(ids))
        self.off = np.r_[0, np.cumsum(size)]
        self.limit = np.repeat(self.off[1:], size)
        self.hits, self.nodes = self._placed(hits, 3), self._placed(nodes, 4)

    def _placed(self, packed: list | None, width: int) -> np.ndarray:
        if packed is None or all(x is None for x in packed):
            return np.zeros((0, width), np.int64)
        parts = [b"" if x is None else x for x in packed]
        out = np.frombuffer(b"".join(parts), "<i8").reshape(-1, width).copy()
        out[:, 0] += np.repeat(self.off[:-1], [len(x) // (8 * width) for x in parts])
        return out

    def by_document(self, rows: np.ndarray) -> list[bytes]:
        """``rows`` (place first) packed per document, places counted from its first line."""
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        cut = np.searchsorted(rows[:, 0], self.off)
        rows[:, 0] -= np.repeat(self.off[:-1], np.diff(cut))
        return [np.ascontiguousarray(rows[a:b], "<i8").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def room(self) -> np.ndarray:
        """Lines from each place on to the end of its run of repeated lines."""
        repeated = np.zeros(len(self.ids), bool)
        repeated[self.hits[self.hits[:, 1] == 1, 0]] = True
        return np.minimum(_run_ends(repeated), self.limit) - np.arange(len(self.ids))

    def doublings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(place, lines, name)`` of all runs of 2, 4, 8 ... repeated lines."""
        room, pos, size, names = self.room(), [], [], []
        for k, level in enumerate(_levels(self.ids, int(room.max(initial=1)).bit_length() - 1)[1:], 1):
            at = np.flatnonzero(room[:len(level)] >= 1 << k)
            pos.append(at)
            size.append(np.full(at.size, 1 << k))
            names.append(level[at])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *pos]), np.concatenate([none, *size]), np.concatenate([self.ids[:0], *names])

    def questions(self, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(place, lines, name)`` of the next lengths of all nodes, ``2**step`` lines apart."""
        p, t, m = self.nodes[:, 0], self.nodes[:, 1], self.nodes[:, 2]
        room, levels = self.room(), _levels(self.ids, int(t.max(initial=0)))
        none = np.zeros(0, np.int64)
        pos, size, names = [none], [none], [self.ids[:0]]
        for k in np.unique(t[t > step]).tolist():
            own = np.flatnonzero(t == k)
            for i in range(1, min(1 << _BITS, 1 << (k - step))):
                own = own[m[own] + (i << step) <= room[p[own]]]
                q, want = p[own], m[own] + (i << step)
                pos.append(q)
                size.append(want)
                names.append(_mix(levels[k][q], levels[k][q + want - (1 << k)], 64) ^ want.astype(np.uint64)[:, None])
        # A place may stand in several nodes that ask about the same run.
        pos, size, names = np.concatenate(pos), np.concatenate(size), np.concatenate(names)
        _, one = np.unique(pos * (1 << 32) + size, return_index=True)
        return pos[one], size[one], names[one]

    def first_nodes(self, doubled: np.ndarray) -> np.ndarray:
        """Nodes to begin the descent with: from the highest power of two that an
        earlier place shares up to the highest that any place shares."""
        hits = np.concatenate([self.hits, doubled])
        level = np.frexp(hits[:, 1].astype(np.float64))[1] - 1
        top, low = (np.full(len(self.ids), -1) for _ in range(2))
        np.maximum.at(top, hits[:, 0], level)
        np.maximum.at(low, hits[:, 0], np.where(hits[:, 2] == 1, level, -1))
        begin = np.maximum(low, 0)
        each = np.maximum(top - begin + 1, 0)
        pos = np.repeat(np.arange(len(top)), each)
        k = np.arange(len(pos)) - np.repeat(np.cumsum(each) - each, each) + begin[pos]
        return np.stack([pos, k, 1 << k, (k == low[pos]).astype(np.int64)], axis=1)

    def descend(self, said: np.ndarray, step: int) -> np.ndarray:
        """Nodes after a round: a place stays where it is the first of every longer
        interval, and stands in every longer interval it is in up to the longest."""
        key = said[:, 0] * (1 << 32) + said[:, 1]
        order = np.argsort(key)
        key, later = np.append(key[order], -1), np.append(said[order, 2], 0)
        p, t, m = self.nodes[:, 0], self.nodes[:, 1], self.nodes[:, 2]
        now, flag = m.copy(), self.nodes[:, 3].copy()
        on, above = t > step, []
        for i in range(1, 1 << _BITS):
            want = p * (1 << 32) + m + (i << step)
            at = np.searchsorted(key[:-1], want)               # behind the last: the key that matches nothing
            on = on & (i < np.left_shift(1, np.maximum(t - step, 0))) & (key[at] == want)
            if not on.any():
                break
            deeper = on & (later[at] == 1)
            now[deeper], flag[deeper] = m[deeper] + (i << step), 1
            first = np.flatnonzero(on & (later[at] == 0))
            above.append(np.stack([p[first], t[first], m[first] + (i << step), np.zeros(first.size, np.int64)], axis=1))
        return np.unique(np.concatenate([np.stack([p, t, now, flag], axis=1), *above]), axis=0)


def _ints(x, width: int) -> np.ndarray:
    return np.frombuffer(x, "<i8").reshape(-1, width)


def _round(state: DataFrame, step: int | None, first: bool, name: str) -> DataFrame:
    """One round over the documents' ``(id, h, ids, lens, hits, nodes)``: the lines
    (``first``), their doublings (``step`` None) or a part of the descent."""
    id_t = state.schema["id"].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, _DOCS):
                part = b.slice(lo, _DOCS)
                seq = _Lines(*(part.column(c).to_pylist() for c in (2, 3, 4)))
                if first:
                    pos, size, names = np.arange(len(seq.ids)), np.ones(len(seq.ids), np.int64), seq.ids
                else:
                    pos, size, names = seq.doublings() if step is None else seq.questions(step)
                doc = np.searchsorted(seq.off, pos, "right") - 1
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array(pos - seq.off[doc]), pa.array(size.astype(np.int64)),
                     pa.array(np.ascontiguousarray(names[:, 0]).view(np.int64)), pa.array(np.ascontiguousarray(names[:, 1]).view(np.int64))],
                    ["id", "h", "pos", "n", "hi", "lo"])
        give_back()
    # Written once: it is grouped by name, and its places are looked up among the names that occur twice.
    asked = saved(state.select("id", "h", "ids", "hits", "nodes").mapInArrow(
        ask, f"id {id_t}, h long, pos long, n long, hi long, lo long"), f"{name}-asked")
    place = F.struct("id", "h", "pos")
    twice = (asked.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("first"))
             .where(F.col("c") > 1).select("hi", "lo", "first"))
    said = (asked.join(twice, ["hi", "lo"]).select("id", "h", "pos", "n", (~place.eqNullSafe(F.col("first"))).cast("long").alias("later"))
            .groupBy("id", "h").agg(F.collect_list(F.struct("pos", "n", "later")).alias("said")))
    s, a = state.alias("s"), said.alias("a")
    joined = s.join(a, F.col("s.id").eqNullSafe(F.col("a.id")) & (F.col("s.h") == F.col("a.h")), "inner" if first else "left") \
        .select("s.id", "s.h", "s.ids", "s.lens", "s.hits", "s.nodes", "a.said")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(lo, _DOCS) for x in batches for lo in range(0, x.num_rows, _DOCS)):
            seq = _Lines(*(b.column(c).to_pylist() for c in (2, 4, 5)))
            lists = b.column(6)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            got = np.stack([flat.field(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1).astype(np.int64)
            got[:, 0] += np.repeat(seq.off[:-1], size)
            if first:
                hits, nodes = seq.by_document(got), [None] * b.num_rows
            else:
                hits = b.column(4)
                nodes = seq.by_document(seq.first_nodes(got) if step is None else seq.descend(got, step))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], hits if isinstance(hits, pa.Array) else pa.array(hits, pa.binary()), pa.array(nodes, pa.binary())],
                ["id", "h", "ids", "lens", "hits", "nodes"])
        give_back()
    return saved(joined.mapInArrow(settle, f"id {id_t}, h long, ids binary, lens binary, {_STATE}"), name)


def maximal_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, h, lens, runs)`` of every document with a repeated line (``h``: hash of the
    text): ``runs`` packs ``(place, lines)`` pairs (i64), the longest run from each
    place on that also begins at an earlier place. Documents go by id (null
    first), then text hash; rows equal in both are one document."""
    id_t = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(lo, _DOCS) for x in batches for lo in range(0, x.num_rows, _DOCS)):
            ids, lens = [], []
            for t in b.column(2).to_pylist():
                lines = t.split("\n")
                ids.append(b"".join(xxhash.xxh3_128_digest(x) for x in lines))
                lens.append(np.fromiter(map(len, lines), "<i4", len(lines)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array(lens, pa.binary()),
                                              pa.nulls(b.num_rows, pa.binary()), pa.nulls(b.num_rows, pa.binary())],
                                             ["id", "h", "ids", "lens", "hits", "nodes"])
        give_back()
    src = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"),
                                                         F.col(text_col).cast("string").alias("t"))
    cutted = saved(src.mapInArrow(cut, f"id {id_t}, h long, ids binary, lens binary, {_STATE}"), "line-ids")
    state = _round(cutted.dropDuplicates(["id", "h"]), None, True, "line-names")
    state = _round(state, None, False, "line-doublings")

    @F.pandas_udf("long")
    def level(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for col in batches:
            yield col.map(lambda x: int(_ints(x, 4)[:, 1].max(initial=0)))
        give_back()
    top = state.agg(F.max(level("nodes"))).first()[0] or 0
    for step in range((max(top, 1) - 1) // _BITS * _BITS, -1, -_BITS):
        if top > step:
            state = _round(state, step, False, f"line-descent-{step}")

    @F.pandas_udf("binary")
    def runs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(x):
            n = _ints(x, 4)
            n = n[n[:, 3] == 1]
            n = n[np.lexsort((-n[:, 2], n[:, 0]))]
            keep = np.r_[True, n[1:, 0] != n[:-1, 0]] if len(n) else np.zeros(0, bool)
            return np.ascontiguousarray(n[keep][:, [0, 2]], "<i8").tobytes()
        for col in batches:
            yield col.map(one)
        give_back()
    return state.select("id", "h", "lens", runs("nodes").alias("runs"))


def deleted(lens: np.ndarray, runs: np.ndarray, min_lines: int, min_chars: int) -> np.ndarray:
    """Mask of a document's lines that a run within the limits covers."""
    total = np.r_[0, np.cumsum(lens, dtype=np.int64)]
    end = runs[:, 0] + runs[:, 1]
    ok = (runs[:, 1] >= min_lines) & (total[end] - total[runs[:, 0]] >= min_chars)
    edge = np.zeros(len(lens) + 1, np.int64)
    np.add.at(edge, runs[ok, 0], 1)
    np.add.at(edge, end[ok], -1)
    return np.cumsum(edge)[:-1] > 0


_RESULT = T.StructType([T.StructField("text", T.StringType()),
                        *(T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed", "n_runs"))])


def drop_repeated_lines(docs: DataFrame, min_lines: int = 1, min_chars: int = 50, id_col: str = "doc_id",
                        text_col: str = "text", chars_col: str | None = "n_chars", report: bool = False) -> DataFrame:
    r"""``docs`` with the later copies of maximal repeated line runs deleted from its text.

    Lines are ``\n``-split. For every line the longest run from it on that begins at an
    earlier place too (in the same document or one before it) is deleted if it has
    ``min_lines`` lines and ``min_chars`` code points or more (line breaks not
    counted); one long line is a run. Runs are judged on the input and may overlap.
    Documents go by id (null first), equal ids by text hash.
    Rows equal in id and text are one document and keep the same lines. A text of
    which every line goes becomes empty; a null text stays null; an empty table
    stays empty. Other columns stay, whatever their names; ``chars_col``, if the table
    has it, becomes the new length of a changed text. ``report`` adds n_lines,
    n_removed and n_runs (maximal deleted spans), replacing columns of those names.
    A document's line IDs (16 bytes a line) and its nodes are held by one task."""
    @F.pandas_udf("binary")
    def gone(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lens, runs in batches:
            yield pd.Series([np.packbits(deleted(np.frombuffer(a, "<i4"), _ints(r, 2), min_lines, min_chars)).tobytes()
                             for a, r in zip(lens, runs, strict=True)], dtype=object)
        give_back()

    @F.pandas_udf(_RESULT)
    def without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, mask in ((x.iloc[lo:lo + _DOCS], y.iloc[lo:lo + _DOCS]) for x, y in batches for lo in range(0, len(x), _DOCS)):
            out = []
            for t, m in zip(text, mask, strict=True):
                parts = (t or "").split("\n")
                if m is None or t is None:
                    out.append((t, len(parts), 0, 0))
                    continue
                g = np.unpackbits(np.frombuffer(m, np.uint8), count=len(parts)).astype(bool)
                spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + g[0])
                out.append(("\n".join(p for p, x in zip(parts, g, strict=True) if not x), len(parts), int(g.sum()), spans))
            yield pd.DataFrame(out, columns=["text", "n_lines", "n_removed", "n_runs"])
        give_back()
    found = maximal_runs(docs, id_col, text_col)
    key, hsh, mask, new = (fresh(docs.columns, c) for c in ("id", "h", "mask", "new"))
    found = found.where(F.length("runs") > 0).select(F.col("id").alias(key), F.col("h").alias(hsh), gone("lens", "runs").alias(mask))
    joined = docs.join(found, docs[id_col].eqNullSafe(found[key]) & (F.xxhash64(docs[text_col]) == found[hsh]), "left")
    made = ("n_lines", "n_removed", "n_runs") if report else ()
    cols = []
    for c in docs.columns:
        if c in made:
            continue
        if c == text_col:
            cols.append(F.col(f"{new}.text").alias(c))
        elif c == chars_col:
            cols.append(F.when(F.col(f"{new}.n_removed") > 0, F.length(f"{new}.text").cast(docs.schema[c].dataType)).otherwise(docs[c]).alias(c))
        else:
            cols.append(docs[c])
    return joined.withColumn(new, without(docs[text_col], found[mask])).select(*cols, *[F.col(f"{new}.{c}").alias(c) for c in made])
