"""Words of many texts at once: byte masks, a dictionary of distinct words and codes.

The texts of an Arrow batch are one byte buffer with row offsets; a word never
crosses a row. A long buffer is worked off in tiles that end between two words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of A-Z become a-z, all others stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def byte_set(*spans: tuple[int, int]) -> np.ndarray:
    """Mask of 256 bytes: true within the (inclusive) spans."""
    out = np.zeros(256, bool)
    for lo, hi in spans:
        out[lo:hi + 1] = True
    return out


def find_words(buf: np.ndarray, word: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the code of each word in order, and its first byte.
    ``word`` marks the word bytes of ``buf``; rows begin at ``edges``."""
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = edges[(edges > 0) & (edges < buf.size)]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start = np.flatnonzero(first)
    off = np.zeros(start.size + 1, np.int32)
    np.cumsum(np.flatnonzero(last) + 1 - start, out=off[1:])
    words = pa.Array.from_buffers(pa.binary(), start.size, [None, pa.py_buffer(off), pa.py_buffer(buf[word])])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), start


def tiles(cut: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Spans of about ``size`` bytes that cover a buffer of ``cut.size`` bytes;
    a span ends behind a byte where ``cut`` holds (later than ``size``, if none does)."""
    lo, n = 0, cut.size
    while lo < n:
        hi = min(lo + size, n)
        if hi < n:
            at = np.flatnonzero(cut[lo:hi])
            if at.size:
                hi = lo + int(at[-1]) + 1
            else:
                step = 1 << 20
                while hi < n:
                    at = np.flatnonzero(cut[hi:hi + step])
                    if at.size:
                        hi += int(at[0]) + 1
                        break
                    hi = min(hi + step, n)
        yield lo, hi
        lo = hi
