"""Quality rules on repetition, from a suffix array over each document's words.

All documents of a slice share one suffix array: suffixes are ordered by prefix
doubling over (document, word) ranks, so no suffix compares past its document,
and a suffix leaves the rounds as soon as its rank is unique. The rank levels
give the longest common prefix of neighbours (binary lifting). A suffix's longest
repeat is the larger of its two neighbours' common prefixes; repeats of
``min_repeat`` words or more are united into spans, and a document fails when the
spans cover too large a part of it or when its longest repeat is too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbweave.llm.common import text_bytes
from kbweave.llm.textvec import SPACE, Prefix, covered, lines, per_row, slices, words

# Characters counted as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def longest_repeats(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each place the length of the longest string from there on that also
    starts elsewhere in the same row (0: none). ``key``: a symbol per place;
    places are in order and rows are contiguous."""
    n = len(key)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    _, rank = np.unique(key, return_inverse=True)
    _, rank = np.unique(row.astype(np.int64) * n + rank, return_inverse=True)
    last = np.searchsorted(row, row, "right")            # end of the place's row
    live = np.flatnonzero(np.bincount(rank)[rank] > 1)
    levels, h, top = [rank], 1, int(rank.max()) + 1
    while len(live):
        # Order the live suffixes by (rank, rank h further on); the others stay.
        nxt = live + h
        after = np.where(nxt < last[live], rank[np.minimum(nxt, n - 1)] + 1, 0)
        order = np.lexsort((after, rank[live]))
        a, b = rank[live][order], after[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        group = np.concatenate(([True], a[1:] != a[:-1]))
        # A suffix gets its group's rank plus the number of live ones before it in the group.
        place = np.arange(len(a))
        start = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        if h == 1 and top == int(rank.max()) + 1:
            # Spread dense ranks to counts, so that there is room inside a group.
            size = np.bincount(rank)
            base = np.concatenate(([0], np.cumsum(size)[:-1]))
            rank = base[rank]
            levels[0] = rank
            a = rank[live][order]
            top = n + 1
        fresh = rank.copy()
        fresh[live[order]] = a + start
        rank = fresh
        levels.append(rank)
        h *= 2
        size = np.bincount(rank, minlength=n)
        live = live[size[rank[live]] > 1]
    sa = np.argsort(rank, kind="stable")
    i, j = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        step = 1 << level
        ok = (i < n) & (j < n)
        same = np.zeros(n - 1, bool)
        r = levels[level]
        same[ok] = r[i[ok]] == r[j[ok]]
        lcp += step * same
        i += step * same
        j += step * same
    np.maximum.at(out, sa[:-1], lcp)
    np.maximum.at(out, sa[1:], lcp)
    return out


def measure(buf: np.ndarray, off: np.ndarray, min_repeat: int) -> dict[str, np.ndarray]:
    """The rule inputs of every row of a slice."""
    n_row = len(off) - 1
    s, e, row = words(buf, off)
    prefix = Prefix(buf)
    longest = longest_repeats(prefix(s, e), row)
    three = np.flatnonzero(longest >= 3)
    long = np.flatnonzero(longest >= min_repeat)
    in_three = covered(three, np.full(len(three), 3), len(s))
    in_long = covered(long, longest[long], len(s))
    of_byte = np.repeat(np.arange(n_row), np.diff(off))
    char = ((buf & 0xC0) != 0x80) & ~SPACE[buf]
    ls, le, lrow = lines(buf, off)
    solid = np.concatenate(([0], np.cumsum(~SPACE[buf])))
    full = solid[le] > solid[ls]
    ls, le, lrow = ls[full], le[full], lrow[full]
    by_line = np.stack([lrow.astype(np.uint64), prefix(ls, le), (le - ls).astype(np.uint64)], axis=1) if len(ls) else \
        np.zeros((0, 3), np.uint64)
    first = np.unique(by_line, axis=0)[:, 0].astype(np.int64)
    top = np.zeros(n_row, np.int64)
    np.maximum.at(top, row, longest)
    return {
        "n_words": np.bincount(row, minlength=n_row), "word_chars": per_row(char, of_byte, n_row),
        "n_symbols": per_row(SYMBOLS[buf], of_byte, n_row),
        "n_dup_lines": np.bincount(lrow, minlength=n_row) - np.bincount(first, minlength=n_row),
        "n_repeat_words": per_row(in_three, row, n_row), "n_covered_words": per_row(in_long, row, n_row),
        "longest_repeat": np.where(top >= min_repeat, top, 0)}


def repetition_rules(docs: DataFrame, min_words: int = 50, max_repeat_pct: int = 50, min_repeat: int = 8,
                     max_covered: float = 0.3, max_longest: int = 100, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per input row: the counts, ``base_failed`` and ``kept``.

    Words are runs without ASCII white space. ``base_failed``: fewer than
    ``min_words`` words, or more than ``max_repeat_pct`` percent of the words in
    3-word windows found twice or more. ``kept``: not base_failed, repeats of
    ``min_repeat`` words or more cover at most ``max_covered`` of the words, and
    the longest has at most ``max_longest`` words. Null text has no words; a null
    id or a repeated row is a row like any other; an empty table gives no rows;
    other columns are ignored. No shuffle; memory follows the longest text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to in slices(b, 1):
                part = b.slice(at, to - at)
                got = measure(*text_bytes(part.column(1)), min_repeat)
                failed = (got["n_words"] < min_words) | (100 * got["n_repeat_words"] > max_repeat_pct * got["n_words"])
                kept = ~failed & (got["n_covered_words"] <= max_covered * got["n_words"]) & \
                    (got["longest_repeat"] <= max_longest)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(got[f], pa.int64()) for f in FIELDS), pa.array(failed), pa.array(kept)],
                    [id_col, *FIELDS, "base_failed", "kept"])

    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = f"`{id_col}` {src.schema[0].dataType.simpleString()}, " + ", ".join(f"{f} long" for f in FIELDS)
    return src.mapInArrow(run, schema + ", base_failed boolean, kept boolean")
