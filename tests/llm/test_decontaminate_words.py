"""Decontamination: the count of shared words that comes before the subsequence."""

import numpy as np
import pyarrow as pa

from kbweave.llm import decontaminate as D


def test_words_are_counted_before_windows_become_candidates():
    """What the signatures leave out is what ``check`` refuses; few windows are left to it."""
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"w{i}" for i in range(400)])
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (3, 20, 40, 0)]
    s = D.Settings(buckets=1 << 10)
    items = D.Items([1, 2, 3, 4], texts, np.ones((s.buckets, 4), np.float32), s)
    h, row = D.terms(pa.array([" ".join(rng.choice(vocabulary, 3000)), texts[1] + " end", None, texts[2]]))
    sign = (h & np.uint64(items.signs.shape[1] - 1)).astype(np.int64)
    lo = rng.integers(0, len(h) - 60, 9000)
    lo[:2] = np.flatnonzero(row == 1)[0], np.flatnonzero(row == 3)[0]
    hi, item = np.minimum(lo + rng.integers(0, 60, len(lo)), len(h)), rng.integers(0, 3, len(lo))
    hi[:2], item[:2] = lo[:2] + (20, 40), (1, 2)
    ok = D.enough_words(sign, lo, hi, item, items, s)
    shares = np.array([D.check(items.words[i], h[a:b], s)[0] for i, a, b in zip(item, lo, hi, strict=True)])
    assert ok[:2].all() and ok[shares >= s.min_lcs].all()
    long = item > 0
    assert ok[long].sum() < long.sum() / 10
