"""Vectorised work on the UTF-8 bytes of whole text columns.

A slice of rows is one byte buffer with row offsets; words, lines and windows are
found and hashed for all rows at once, without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from kbweave.llm.common import give_back, text_bytes

# White space between words: space and the five controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Base powers and their inverses modulo 2**64; grown as needed (to steps of 2**18) and
    kept by the worker process until ``let_go``."""
    global _pow, _inv
    if len(_pow) < n:
        size = -(-n >> 18) << 18
        _pow, _inv = np.full(size, _BASE, np.uint64), np.full(size, _INV, np.uint64)
        _pow[0] = _inv[0] = 1
        np.cumprod(_pow, out=_pow)
        np.cumprod(_inv, out=_inv)
    return _pow, _inv


def let_go() -> None:
    """Forget the powers and return freed memory: what a task calls at its end."""
    global _pow, _inv
    _pow, _inv = np.ones(1, np.uint64), np.ones(1, np.uint64)
    give_back()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (all bits depend on all bits)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Prefix:
    """Hash of any byte range of a buffer in constant time: a polynomial over
    random byte values modulo 2**64, from prefix sums."""

    def __init__(self, buf: np.ndarray):
        self.p = np.zeros(len(buf) + 1, np.uint64)
        power, self.inv = _powers(len(buf) + 1)
        np.cumsum(_BYTE[buf] * power[:len(buf)], out=self.p[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.p[end] - self.p[start]) * self.inv[start])


def slices(batch: pa.RecordBatch, text_at: int, max_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` of text each (a longer row is a range of its own)."""
    n = batch.num_rows
    if not n:
        return
    _, off = text_bytes(batch.column(text_at))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, row)`` of all words; a word never spans rows."""
    solid = ~SPACE[buf]
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.zeros(len(buf) + 1, bool)
    cut[off] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | cut[1:len(buf)]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | cut[1:len(buf)]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(off, s, "right") - 1


def lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""``(start, end, row)`` of all ``\n``-split lines; every row has at least one."""
    brk = np.flatnonzero(buf == 10)
    n_row = len(off) - 1
    row_brk = np.searchsorted(off, brk, "right") - 1
    start = np.concatenate([off[:-1], brk + 1])
    row = np.concatenate([np.arange(n_row), row_brk])
    end = np.concatenate([brk, off[1:]])
    row_end = np.concatenate([row_brk, np.arange(n_row)])
    by_start, by_end = np.lexsort((start, row)), np.lexsort((end, row_end))
    return start[by_start], end[by_end], row[by_start]


def per_row(values: np.ndarray, row: np.ndarray, n_row: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n_row).astype(np.int64)


def covered(starts: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Mask of the places in ``[s, s + length)`` for any s."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + length, n), -1)
    return np.cumsum(d[:-1]) > 0


def add_rows(out: np.ndarray, at: np.ndarray, table: np.ndarray, pick: np.ndarray, step: int = 1 << 12) -> None:
    """``out[at] += table[pick]``, also where ``at`` repeats: rows
    are brought in the order of their places and summed by runs, in double precision."""
    order = np.argsort(at.astype(np.uint16) if len(out) <= 1 << 16 else at, kind="stable")
    for lo in range(0, len(order), step):
        some = order[lo:lo + step]
        a = at[some]
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        out[a[first]] += np.add.reduceat(table[pick[some]], first, axis=0, dtype=np.float64)
