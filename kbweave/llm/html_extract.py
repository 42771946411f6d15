"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks (the text between two block-level tags). Every
block is a vector: the hashed names on its tag path (tags, classes, ids), hashed
words, and a few measures. A bidirectional LSTM in numpy reads the page's blocks
in order and labels each one with the whole page as context; blocks labelled main
text are decoded, squeezed and joined. The network is trained here, on a seeded,
bounded set of made-up pages (``webpages``), and its weights are broadcast.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbweave.llm.common import fresh
from kbweave.llm.textvec import slices
from kbweave.llm.webpages import PageMaker

PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 1024, 128, 10, 24
TRAIN_PAGES, TRAIN_EPOCHS = 1500, 8         # bound of what the labeller is trained on

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>"""
                  r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
                  "tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# No text of a page: scripts, styles, document data, controls and what browsers show instead of the page.
RAW = frozenset("script style textarea title xmp".split())
HIDDEN_TAGS = frozenset("head noscript template svg math iframe object canvas audio video select option button datalist".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)), "tr": ("tr td th", ("table",)),
          "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
BREAK = frozenset({"br"})


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """``(path, text, characters inside links)`` of every leaf block, in page
    order. The path has one entry per open element: its tag and names."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = hidden = links = 0
    path: tuple[str, ...] = ()

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(htmllib.unescape("".join(parts)).split())
            if text:
                out.append((path, text, linked))
            parts.clear()
        linked = 0

    def pop_to(i):
        nonlocal hidden, links
        for tag, _ in stack[i:]:
            hidden -= tag in HIDDEN_TAGS
            links -= tag == "a"
        del stack[i:]

    def add_text(s):
        nonlocal linked, path
        if hidden or not s:
            return
        if not parts:
            if s.isspace():
                return
            path = tuple(x for t, x in stack if t in BLOCK or t == "span" or t == "a")
        parts.append(s)
        if links:
            linked += len(s)

    at = 0
    search = _TAG.search
    while True:
        m = search(page, at)
        if m is None:
            add_text(page[at:])
            break
        add_text(page[at:m.start()])
        at = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in BREAK:
            add_text(" ")
            continue
        if tag in RAW:
            if not close:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in BLOCK:
            flush()
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if tag not in BLOCK and tag not in HIDDEN_TAGS and stack[i][0] in BLOCK:
                    break                              # an inline end tag never closes a block
            continue
        if tag in VOID:
            continue
        if tag == "body":                              # ends a head that was not closed
            for i, (t, _) in enumerate(stack):
                if t == "head":
                    pop_to(i)
                    break
        if tag in BLOCK:                               # a new block ends an open paragraph, with its inline elements
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if tag in CLOSES:
            ends, scope = CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in scope:
                    break
                if stack[i][0] in ends.split():
                    pop_to(i)
                    break
        names = " ".join(a or b or c for a, b, c in _NAME.findall(attrs)).lower() if attrs else ""
        stack.append((tag, f"{tag} {names}" if names else tag))
        hidden += tag in HIDDEN_TAGS
        links += tag == "a"
    flush()
    return out


@lru_cache(maxsize=20_000)
def _path_ids(path: tuple[str, ...]) -> tuple[int, ...]:
    """Hashed names of a path: every tag, tag with its parent, whole names and their words."""
    ids, parent = set(), ""
    for x in path:
        tag, _, names = x.partition(" ")
        ids.add(crc32(f"t:{tag}".encode()) % PATH_DIM)
        ids.add(crc32(f"p:{parent}>{tag}".encode()) % PATH_DIM)
        for n in names.split():
            ids.add(crc32(f"n:{n}".encode()) % PATH_DIM)
        for n in _WORDS.findall(names):
            ids.add(crc32(f"w:{n}".encode()) % PATH_DIM)
        parent = tag
    return tuple(sorted(ids))


def features(page: list[tuple[tuple[str, ...], str, int]]) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """``(path ids, dense part)`` of a page's blocks."""
    n = len(page)
    dense = np.zeros((n, WORD_DIM + MEASURES), np.float32)
    for i, (path, text, linked) in enumerate(page):
        w = text.lower().encode().split()
        ids = np.fromiter(map(crc32, w), np.int64, len(w)) % WORD_DIM
        counts = np.bincount(ids, minlength=WORD_DIM)
        dense[i, :WORD_DIM] = counts / np.sqrt(max(1, len(w)))
        last = path[-1].split(" ")[0] if path else ""
        dense[i, WORD_DIM:] = (np.log1p(len(w)) / 5, min(1.0, linked / max(1, len(text))), last[:1] == "h" and last[1:].isdigit(),
                               last == "li", last == "p", "©" in text, i / n, i == 0, i == n - 1, min(len(path), 12) / 12)
    return [_path_ids(p) for p, _, _ in page], dense


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """Two LSTMs over the blocks, one in each direction, and a linear read-out."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        d, h = PATH_DIM + WORD_DIM + MEASURES, HIDDEN
        self.w = {}
        for k in "fb":
            self.w["x" + k] = r.normal(0, 0.08, (d, 4 * h)).astype(np.float32)
            self.w["h" + k] = r.normal(0, h ** -0.5, (h, 4 * h)).astype(np.float32)
            self.w["c" + k] = np.zeros(4 * h, np.float32)
            self.w["c" + k][h:2 * h] = 1
        self.w["o"] = r.normal(0, 0.1, (2 * h,)).astype(np.float32)
        self.w["s"] = np.zeros(d, np.float32)
        self.w["e"] = np.zeros(1, np.float32)

    def _inputs(self, pages, word_scale=None):
        """Padded ``(T, B, .)`` projections of a batch of feature pages."""
        size = np.array([len(p[0]) for p in pages])
        t, b = int(size.max()), len(pages)
        flat_ids = [i for p in pages for i in p[0]]
        distinct = {i: n for n, i in enumerate(dict.fromkeys(flat_ids))}
        dense = np.concatenate([p[1] for p in pages])
        if word_scale is not None:
            dense = dense.copy()
            dense[:, :WORD_DIM] *= np.repeat(word_scale, size)[:, None]
        which = np.array([distinct[i] for i in flat_ids])
        row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        col = np.repeat(np.arange(b), size)
        return size, t, b, list(distinct), which, dense, row, col

    def _project(self, key, distinct, which, dense):
        w = self.w[key]
        p = np.array([w[list(i)].sum(axis=0) if i else np.zeros(w.shape[1:], np.float32) for i in distinct], np.float32)
        return p[which] + dense @ w[PATH_DIM:]

    def _run(self, k, z, mask):
        """One direction over ``z (T, B, 4h)``; keeps what the gradient needs."""
        t, b, _ = z.shape
        h = HIDDEN
        hs, cs, gates = np.zeros((t + 1, b, h), np.float32), np.zeros((t + 1, b, h), np.float32), np.zeros((t, b, 4 * h), np.float32)
        for i in range(t):
            a = z[i] + hs[i] @ self.w["h" + k]
            g = np.concatenate([_sigmoid(a[:, :3 * h]), np.tanh(a[:, 3 * h:])], axis=1)
            c = g[:, h:2 * h] * cs[i] + g[:, :h] * g[:, 3 * h:]
            m = mask[i][:, None]
            cs[i + 1] = np.where(m, c, cs[i])
            hs[i + 1] = np.where(m, g[:, 2 * h:3 * h] * np.tanh(c), hs[i])
            gates[i] = g
        return hs, cs, gates

    def forward(self, pages, word_scale=None):
        size, t, b, distinct, which, dense, row, col = self._inputs(pages, word_scale)
        back = size[col] - 1 - row                 # place of a block in the reversed page
        mask = np.arange(t)[:, None] < size[None, :]
        state = {}
        out = self._project("s", distinct, which, dense) + self.w["e"][0]
        for n, (k, r) in enumerate((("f", row), ("b", back))):
            z = np.zeros((t, b, 4 * HIDDEN), np.float32)
            z[r, col] = self._project("x" + k, distinct, which, dense) + self.w["c" + k]
            state[k] = self._run(k, z, mask)
            out = out + state[k][0][r + 1, col] @ self.w["o"][n * HIDDEN:(n + 1) * HIDDEN]
        return out, (size, t, b, distinct, which, dense, row, col, back, mask, state)

    def gradients(self, pages, labels, word_scale):
        out, (size, t, b, distinct, which, dense, row, col, back, mask, state) = self.forward(pages, word_scale)
        d_out = (_sigmoid(out) - labels) / len(labels)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        n_ids = [np.array(i, np.int64) for i in distinct]
        at = np.concatenate([n_ids[i] for i in which])
        of = np.repeat(np.arange(len(which)), [len(n_ids[i]) for i in which])
        order = np.argsort(at, kind="stable")
        at, of = at[order], of[order]
        edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))

        def into(key, d):
            g[key][at[edge]] += np.add.reduceat(d[of], edge, axis=0)
            g[key][PATH_DIM:] += dense.T @ d
        into("s", d_out)
        g["e"][0] = d_out.sum()
        h = HIDDEN
        for n, (k, r) in enumerate((("f", row), ("b", back))):
            hs, cs, gates = state[k]
            read = self.w["o"][n * h:(n + 1) * h]
            g["o"][n * h:(n + 1) * h] = hs[r + 1, col].T @ d_out
            d_h_all = np.zeros((t, b, h), np.float32)
            d_h_all[r, col] = d_out[:, None] * read
            dz = np.zeros((t, b, 4 * h), np.float32)
            dh, dc = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
            for i in range(t - 1, -1, -1):
                m = mask[i][:, None]
                q, c = gates[i], np.tanh(cs[i + 1])
                dh_i = dh + d_h_all[i]
                dc_i = dc + dh_i * q[:, 2 * h:3 * h] * (1 - c * c)
                a = np.concatenate([dc_i * q[:, 3 * h:], dc_i * cs[i], dh_i * c], axis=1) * q[:, :3 * h] * (1 - q[:, :3 * h])
                a = np.where(m, np.concatenate([a, dc_i * q[:, :h] * (1 - q[:, 3 * h:] ** 2)], axis=1), 0)
                dz[i] = a
                dh = np.where(m, a @ self.w["h" + k].T, dh)
                dc = np.where(m, dc_i * q[:, h:2 * h], dc)
            g["h" + k] = np.tensordot(hs[:-1], dz, axes=([0, 1], [0, 1]))
            d = dz[r, col]
            g["c" + k] = d.sum(axis=0)
            into("x" + k, d)
        return g

    def label(self, pages: list) -> list[np.ndarray]:
        """Main-text mask of every feature page; pages of like length run together."""
        out: list = [np.zeros(0, bool)] * len(pages)
        some = sorted((i for i, p in enumerate(pages) if len(p[0])), key=lambda i: len(pages[i][0]))
        at = 0
        while at < len(some):
            top = len(pages[some[at]][0])
            to = at
            while to < len(some) and to - at < 256 and len(pages[some[to]][0]) <= 1.25 * top + 2:
                to += 1
            part = some[at:to]
            score, (size, *_) = self.forward([pages[i] for i in part])
            for i, s in zip(part, np.split(score, np.cumsum(size)[:-1]), strict=True):
                out[i] = s > 0
            at = to
        return out


@lru_cache(maxsize=2)
def trained(n_pages: int = TRAIN_PAGES, epochs: int = TRAIN_EPOCHS, seed: int = 7) -> Labeller:
    """The labeller, fitted with Adam to ``n_pages`` made-up pages. Word features
    are left out of half of the pages, so that it does not lean on words."""
    maker, data = PageMaker(seed), []
    for _ in range(n_pages):
        page, labels = maker.page()
        got = blocks(page)
        if len(got) != len(labels):
            raise ValueError("a made-up page was cut differently from its labels")
        data.append((features(got), np.array(labels, np.float32)))
    data.sort(key=lambda x: len(x[1]))
    net, r = Labeller(), np.random.default_rng(seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    groups, step = [data[i:i + 24] for i in range(0, len(data), 24)], 0
    for epoch in range(epochs):
        rate = 0.012 * (1 - epoch / epochs) + 0.001
        for i in r.permutation(len(groups)):
            pages = [p for p, _ in groups[i]]
            scale = (r.random(len(pages)) < 0.5).astype(np.float32)
            g = net.gradients(pages, np.concatenate([y for _, y in groups[i]]), scale)
            step += 1
            for k, v in g.items():
                v = np.clip(v, -1, 1) + 1e-5 * net.w[k]
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.01 * (v * v - m2[k])
                net.w[k] -= rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-8)
    return net


def main_text(net: Labeller, pages: list[str]) -> list[str]:
    cut = [blocks(p) for p in pages]
    masks = net.label([features(c) for c in cut])
    return ["\n".join(t for (_, t, _), m in zip(c, mask, strict=True) if m) for c, mask in zip(cut, masks, strict=True)]


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars",
                      net: Labeller | None = None) -> DataFrame:
    """``pages`` with its html replaced by the main text and its code points.

    The whole html is read. A null or empty page, or one without main text, gives
    an empty string. Other columns and all rows stay; columns of the two output
    names are replaced; an empty table stays empty. No shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast((net or trained()).w)
    keep = [c for c in pages.columns if c not in (html_col, text_col, chars_col)]
    src = pages.select(*keep, F.col(html_col).cast("string").alias(fresh(pages.columns, "html")))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[:-1]), f"`{text_col}` string", f"`{chars_col}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller()
        own.w = shared.value
        for b in batches:
            for at, to in slices(b, len(keep)):
                part = b.slice(at, to - at)
                text = main_text(own, [x or "" for x in part.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                    [*keep, text_col, chars_col])
    return src.mapInArrow(run, schema)
