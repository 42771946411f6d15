"""Vectors in packed blocks, grouped by direction, and exact pruned top-k over them.

Documents are put in *cells* (nearest of a bounded number of centres) and, within
a cell, in *blocks* of bounded size: one row holds the ids and the matrix of a
block. For a search the blocks are dealt to *parts* of bounded size: several small
cells, or a share of a large one. Queries travel in packs: one row holds the queries of
a batch that need a cell of a part, and which cells each of them needs. A part's
blocks and its packs meet in one task, blocks first; a cell and the queries of a pack
that need it are compared box by box (``Part``). So that few parts still keep all cores busy, a
part may have several *lanes*: its blocks go to each of them, a pack to one. A
document's vector is shuffled once a lane, a query once for each part that it needs.

A query needs a cell only if the cell can hold one of its k best. By the
triangle inequality for angles a member of a cell with centre ``c`` and radius
``r`` (the widest angle between the centre and a member) has at most the cosine
``cos(max(0, angle(q, c) - r))``; a cell whose bound is below the k-th
similarity that the query has already is skipped.

Only the centres, radii and sizes of the cells go through the driver; there
are at most ``MAX_CELLS`` of them, so they are bounded whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbweave.operators.hashing import SLICE_ROWS, TokenBuckets, counted
from kbweave.operators.partitioning import saved

SIM_DECIMALS = 12
SCORE_BYTES = 32 * 1024 * 1024   # bound on one (documents x queries) float64 score matrix
PACK_BYTES = 1024 * 1024         # vectors of one pack
PART_BYTES = 32 * 1024 * 1024    # vectors of the blocks that one task holds
TILE_ROWS = 2048                 # documents that are compared with a pack at once, at most
BOX_ROWS = 64                    # rows of a box, at most
DENSE_SHARE = 1 / 2              # share of a tile's boxes and queries up to which boxes are compared one by one
LANE_QUERIES = 4096              # queries that make it worth sending a part's documents to one more task
PAIR_SHARE = 1 / 16              # share of a score matrix up to which its pairs are compared one by one
MAX_CELLS = 4096
SAMPLE_ROWS = 65_536             # rows that the centres are fitted on, at most,
SAMPLE_CELL_ROWS = 128           # so many a cell (4,096 at least),
SAMPLE_BYTES = 128 * 1024 * 1024  # and bytes of their vectors (in double precision)
SLACK = 1e-9                     # room for rounding in the cosine bounds


@dataclass(frozen=True)
class Cells:
    """Centres (unit rows), the smallest cosine of a member with its centre, and
    members per cell. The last of ``rows`` counts zero vectors, which have no
    direction and form a cell of their own without centre."""
    centers: np.ndarray
    cos: np.ndarray
    rows: np.ndarray

    @property
    def n(self) -> int:
        return len(self.centers)

    def groups(self, part_rows: int) -> np.ndarray:
        """First cell of each cell's part: cells in a row share one as long as they hold ``part_rows`` rows at most."""
        out, lead, size = np.arange(len(self.rows)), 0, 0
        for i, n in enumerate(self.rows.tolist()):
            if size + n > part_rows:
                lead, size = i, 0
            out[i], size = lead, size + n
        return out

    def shares(self, block_rows: int) -> np.ndarray:
        """Number of shares (of about a block each) of each cell."""
        return np.maximum(1, -(-self.rows // block_rows))

    def bounds(self, sim: np.ndarray) -> np.ndarray:
        """Upper bound of a query's cosine with any member, from its cosines with the centres."""
        sim, cos = np.clip(sim, -1, 1), np.clip(self.cos, -1, 1)[None, :]
        inside = sim >= cos                                    # the query's direction lies within the radius
        far = sim * cos + np.sqrt(1 - sim ** 2) * np.sqrt(1 - cos ** 2)
        return np.where(inside, 1.0, far)


def one_cell(dim: int, rows: int) -> Cells:
    """No partition by direction: one cell around nothing, with every row."""
    return Cells(np.zeros((1, dim)), np.full(1, -1.0), np.array([rows, 0]))


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column (each of ``dim`` numbers, none null) as a matrix."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def hashed(col: pa.Array, dim: int, hasher: TokenBuckets | None) -> np.ndarray:
    """Term frequencies of token lists (hashed by ``hasher``) or of bucket lists; null counts as empty."""
    return counted(col, dim, hasher).astype(np.float32)


def dense(df: DataFrame, dim: int, kind: str) -> DataFrame:
    """``df`` with its last column (``tokens`` or ``buckets``) as ``array<float>`` of term frequencies."""
    keep, last = df.columns[:-1], df.columns[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = TokenBuckets(dim) if kind == "tokens" else None
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(lo, SLICE_ROWS)
                m = hashed(b.column(len(keep)), dim, hasher)
                ends = pa.array(np.arange(0, m.size + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(m.ravel()))], b.schema.names)
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInArrow(run, f"{fields}, `{last}` array<float>")


def vector_type(df: DataFrame) -> str:
    """Number type that ``vec`` is stored in: single precision stays as it is."""
    return "<f4" if "float" in df.schema["vec"].dataType.simpleString() else "<f8"


def unit_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one in double precision; zero rows stay zero and are told."""
    m = m.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
    ok = norms > 0
    m[ok] /= norms[ok, None]
    return m, ok


def fit_centers(sample: np.ndarray, cells: int, seed: int = 0, rounds: int = 8) -> np.ndarray:
    """Directions that the sample's rows gather round (spherical k-means)."""
    rows, ok = unit_rows(sample)
    rows = rows[ok]
    if not len(rows):
        return np.zeros((1, sample.shape[1]))
    rng = np.random.default_rng(seed)
    centers = rows[rng.choice(len(rows), min(cells, len(rows)), replace=False)]
    step = max(1, SCORE_BYTES // (8 * len(centers)))
    for _ in range(rounds):
        own = np.concatenate([np.argmax(rows[i:i + step] @ centers.T, axis=1) for i in range(0, len(rows), step)])
        order = np.argsort(own, kind="stable")
        first = np.searchsorted(own[order], np.arange(len(centers)))
        filled = np.diff(np.r_[first, len(rows)]) > 0
        total = np.add.reduceat(rows[order], first[filled], axis=0)
        moved, sure = unit_rows(total)
        at = np.flatnonzero(filled)[sure]
        centers[at] = moved[sure]
    return centers


def assign(docs: DataFrame, centers: np.ndarray, dim: int) -> DataFrame:
    """``(id, vec)`` rows with ``cell`` and ``cos`` (cosine with the cell's centre)."""
    shared = docs.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            u, ok = unit_rows(matrix(b.column(1), dim))
            cell, cos = np.full(len(u), len(c), np.int32), np.full(len(u), 1.0)
            step = max(1, SCORE_BYTES // (8 * len(c)))
            for lo in range(0, len(u), step):
                s = u[lo:lo + step] @ c.T
                best = np.argmax(s, axis=1)
                cell[lo:lo + step], cos[lo:lo + step] = best, s[np.arange(len(best)), best]
            cell[~ok] = len(c)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell), pa.array(cos)], ["id", "vec", "cell", "cos"])
    vec = docs.schema["vec"].dataType.simpleString()
    return docs.select("id", "vec").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, vec {vec}, cell int, cos double")


def measured(assigned: DataFrame, centers: np.ndarray) -> Cells:
    """Sizes and radii of the cells (at most ``MAX_CELLS + 1`` rows are collected)."""
    got = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("cos")).collect()
    rows, cos = np.zeros(len(centers) + 1, np.int64), np.ones(len(centers))
    for r in got:
        rows[r["cell"]] = r["n"]
        if r["cell"] < len(centers):
            cos[r["cell"]] = r["cos"]
    return Cells(centers, cos - SLACK, rows)


def sample(docs: DataFrame, rows: int, dim: int, cells: int = MAX_CELLS) -> np.ndarray:
    """Of the ``rows`` vectors about as many as the bounds allow (never more), chosen by a hash of the row."""
    limit = max(1, min(SAMPLE_ROWS, max(4096, SAMPLE_CELL_ROWS * cells), SAMPLE_BYTES // (8 * dim)))
    share = min(1.0, limit / max(rows, 1))
    some = docs.where(F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = some.select("vec").limit(limit).toArrow()["vec"].combine_chunks()
    return matrix(got, dim)


def group(docs: DataFrame, rows: int, cells: int, dim: int, seed: int = 0) -> tuple[DataFrame, Cells]:
    """``(id, vec)`` rows with their ``cell`` (written once), and the cells."""
    centers = fit_centers(sample(docs, rows, dim, cells), min(cells, MAX_CELLS), seed)
    assigned = saved(assign(docs, centers, dim), "vector-cells")
    return assigned, measured(assigned, centers)


def slots(df: DataFrame) -> int:
    """Parts that keep the cluster busy, if the input is large enough."""
    return 2 * df.sparkSession.sparkContext.defaultParallelism


def part_rows(cells: Cells, dim: int, block_rows: int, slots: int, kind: str = "<f8") -> int:
    """Rows of a part: at most ``PART_BYTES`` of vectors, at most a slot's share of all, a block at least."""
    most = PART_BYTES // (dim * np.dtype(kind).itemsize)
    return max(block_rows, 1, min(most, -(-int(cells.rows.sum()) // slots)))


def blocks(docs: DataFrame, cells: Cells, dim: int, block_rows: int) -> DataFrame:
    """Rows ``(id, vec, cell)`` as blocks ``(cell, share, ids, data)``. A cell's rows
    are dealt over its shares by a hash of the row, each share is cut into
    blocks of at most ``block_rows`` rows in the order of their ids."""
    shares = [int(x) for x in cells.shares(block_rows)]
    # Shares per cell as a literal list (at most MAX_CELLS + 1 numbers).
    share = F.get(F.from_json(F.lit(str(shares)), "array<int>"), F.col("cell")) if cells.n > 1 else F.lit(shares[0])
    keyed = docs.withColumn("share", F.pmod(F.xxhash64("id", "vec", F.monotonically_increasing_id()), share).cast("int"))
    # A task cuts the blocks of several shares: about four a slot, more if they would hold over PART_BYTES.
    n = min(sum(shares), max(2 * slots(docs), sum(shares) * block_rows * dim * 4 // PART_BYTES))
    dealt = keyed.select("cell", "share", "id", "vec").repartition(n, "cell", "share").sortWithinPartitions("cell", "share", "id")
    kind = vector_type(docs)

    def flush(cell, share, ids, mats):
        m = np.concatenate(mats)
        return pa.RecordBatch.from_arrays(
            [pa.array([cell], pa.int32()), pa.array([share], pa.int32()),
             pa.ListArray.from_arrays(pa.array([0, len(m)], pa.int32()), pa.concat_arrays(ids)),
             pa.array([m.astype(kind).tobytes()], pa.binary())], ["cell", "share", "ids", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, mats, size = None, [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            m = matrix(b.column(3), dim)
            cell, share = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            cut = np.r_[0, np.flatnonzero((np.diff(cell) != 0) | (np.diff(share) != 0)) + 1, len(m)]
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if key is not None and key != (cell[lo], share[lo]) and size:
                    yield flush(*key, ids, mats)
                    ids, mats, size = [], [], 0
                key = (cell[lo], share[lo])
                while lo < hi:
                    to = min(hi, lo + block_rows - size)
                    ids.append(b.column(2).slice(lo, to - lo))
                    mats.append(m[lo:to])
                    size, lo = size + to - lo, to
                    if size == block_rows:
                        yield flush(*key, ids, mats)
                        ids, mats, size = [], [], 0
        if size:
            yield flush(*key, ids, mats)
    return dealt.mapInArrow(run, f"cell int, share int, ids array<{docs.schema['id'].dataType.simpleString()}>, data binary")


def grid(cells: Cells, dim: int, block_rows: int, slots: int, kind: str, asked: int, visits: int) -> tuple[int, int]:
    """Rows of a part, and lanes, that give every core (half the ``slots``) a task. Documents go to
    every lane, each of the ``asked`` queries to ``visits`` cells or every part: the most parts
    that shuffle hardly more than the best choice does. Some cells take far longer than others, so
    there are four tasks a core if the lanes that this takes move half as much as the queries at
    most, and each is to compare its documents with ``LANE_QUERIES`` or more."""
    docs, cores = int(cells.rows.sum()), -(-slots // 2)
    moved = [docs * -(-cores // n) + asked * min(n, visits) for n in range(1, slots + 1)]
    parts = max(n for n, x in enumerate(moved, 1) if x <= 1.1 * min(moved))
    rows = part_rows(cells, dim, block_rows, parts, kind)
    parts = part_numbers(cells, rows)[2]
    sent = asked * min(parts, visits)
    even = min(-(-4 * cores // parts), 1 + sent // (2 * max(docs, 1)), sent // (parts * LANE_QUERIES))
    return rows, max(1, -(-cores // parts), even)


def part_numbers(cells: Cells, part_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First part and number of parts of each cell, and the number of all parts."""
    group = cells.groups(part_rows)
    lead = group == np.arange(len(group))
    n = np.where(lead, cells.shares(part_rows), 0)
    return (np.cumsum(n) - n)[group], n[group], int(n.sum())


def packs(queries: DataFrame, cells: Cells, dim: int, block_rows: int, n_probe: int | None,
          rest: bool = False, lanes: int = 1, together: bool = False) -> DataFrame:
    """Query rows ``(qid, vec, [thr])`` as packs ``(cell, share, lane, qids, needs, least, data)``, one per
    share (of ``block_rows`` rows) of every cell that a query needs: its ``n_probe`` nearest cells (None:
    all, the zero vectors' too), or with ``rest`` the other cells that can hold a
    similarity of ``thr`` or more (null: all of them). With ``together`` the cells of a part
    (``Cells.groups``) get one pack, under the first of them; ``needs`` has a byte for each
    query and cell of the part, ``least`` a ``thr`` for each query (null: none has one)."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)
    shares = cells.shares(block_rows)
    kind = vector_type(queries)
    pack_rows = max(1, PACK_BYTES // (dim * np.dtype(kind).itemsize))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        group = c.groups(block_rows) if together else np.arange(c.n + 1)
        lane = TaskContext.get().partitionId()
        for whole in batches:
            for lo in range(0, whole.num_rows, pack_rows):
                b = whole.slice(lo, pack_rows)
                m = matrix(b.column(1), dim)
                qid = b.column(0).to_numpy(zero_copy_only=False)
                need, thr = np.zeros((len(m), c.n + 1), bool), None
                if n_probe is None or n_probe >= c.n:
                    need[:] = True
                else:
                    u, _ = unit_rows(m)
                    sim = u @ c.centers.T
                    near = np.argpartition(-sim, n_probe - 1, axis=1)[:, :n_probe]
                    need[np.arange(len(m))[:, None], near] = True
                    if rest:
                        thr = b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                        thr = np.where(np.isnan(thr), -np.inf, thr)
                        able = c.bounds(sim) >= thr[:, None] - SLACK
                        need = np.c_[able & ~need[:, :-1], np.isinf(thr)]
                need[:, c.rows == 0] = False
                for cell in np.unique(group[need.any(axis=0)]).tolist():
                    own = need[:, cell:cell + int(np.count_nonzero(group == cell))]
                    rows = np.flatnonzero(own.any(axis=1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cell], pa.int32()), pa.array([int(shares[cell])], pa.int32()), pa.array([lane % lanes], pa.int32()),
                         pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), pa.array(qid[rows])),
                         pa.array([own[rows].tobytes()], pa.binary()), pa.array([None if thr is None else thr[rows].tobytes()], pa.binary()),
                         pa.array([m[rows].astype(kind).tobytes()], pa.binary())],
                        ["cell", "shares", "lane", "qids", "needs", "least", "data"])
                lane += 1
    got = queries.select("qid", "vec", *(["thr"] if rest else [])).mapInArrow(
        run, "cell int, shares int, lane int, qids array<bigint>, needs binary, least binary, data binary")
    return got.select("cell", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "lane", "qids", "needs", "least",
                      F.col("data").alias("qdata"))


def local_topk(q: np.ndarray, sim: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k per query under (similarity descending, document ascending); -inf is NULL."""
    order = np.lexsort((doc, -sim, q))
    qs = q[order]
    starts = np.r_[0, np.flatnonzero(np.diff(qs)) + 1]
    group_start = np.repeat(starts, np.diff(np.r_[starts, qs.size]))
    return order[(np.arange(qs.size) - group_start) < k]


def likely(q: np.ndarray, sim: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Places of the pairs that can be among the first k of their query, if each similarity is right up to ``slack``."""
    order = np.lexsort((-sim, q))
    qs = q[order]
    starts = np.r_[0, np.flatnonzero(np.diff(qs)) + 1][:len(qs)]
    size = np.diff(np.r_[starts, len(qs)])
    least = np.where(size > k, sim[order[np.minimum(starts + k - 1, len(qs) - 1)]] - 2 * slack, -np.inf)
    return order[sim[order] >= np.repeat(least, size)]


class Part:
    """The documents of a part in the order of their ids, ready for packs of queries.

    Rows with a direction stand in *boxes* of at most ``BOX_ROWS`` rows that share their largest
    coordinate. A box knows the range of each coordinate over its rows, hence how large a
    query's cosine with any of them can be; the widest boxes come first."""

    def __init__(self, ids: pa.Array, m: np.ndarray):
        order = pc.sort_indices(ids, null_placement="at_start")
        self.ids, self.m = ids.take(order), m[order.to_numpy()]
        norms = np.concatenate([np.sqrt(np.einsum("ij,ij->i", x, x)) for x in
                                (self.m[lo:lo + 8192].astype(np.float64) for lo in range(0, len(m), 8192))])
        ok = norms > 0
        self.some, self.zero = np.flatnonzero(ok), np.flatnonzero(~ok)       # rows with a direction, and without
        self.norms = norms[self.some]
        unit, top, peak = np.empty((len(self.some), m.shape[1]), np.float32), [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for lo in range(0, len(self.some), 8192):
            u = unit[lo:lo + 8192] = self.exact(np.arange(lo, min(lo + 8192, len(self.some))))
            top.append(np.argmax(np.abs(u), axis=1))
            peak.append(u[np.arange(len(u)), top[-1]])
        by = self._boxes(unit, np.concatenate(top), np.concatenate(peak))
        self.some, self.norms, self.unit = self.some[by], self.norms[by], unit[by]

    def _boxes(self, unit: np.ndarray, top: np.ndarray, peak: np.ndarray) -> np.ndarray:
        """Cuts the rows into boxes; the order of the rows by box."""
        by = np.lexsort((-peak, top))
        new = np.r_[True, np.diff(top[by]) != 0][:len(by)]
        nth = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))   # of its largest coordinate
        first = np.flatnonzero(nth % BOX_ROWS == 0)
        rows = np.diff(np.r_[first, len(by)])
        high, low = (np.array([f(unit[by[i:i + n]], axis=0) for i, n in zip(first.tolist(), rows.tolist(), strict=True)],
                              np.float32).reshape(-1, unit.shape[1]) for f in (np.max, np.min))
        wide = np.sqrt((np.maximum(np.abs(high), np.abs(low)) ** 2).sum(axis=1))
        at = np.argsort(-wide, kind="stable")
        self.high, self.low, self.wide, self.ends = high[at], low[at], wide[at], np.cumsum(rows[at])
        place = np.empty(len(at), np.int64)
        place[at] = np.arange(len(at))
        return by[np.argsort(np.repeat(place, rows), kind="stable")]

    def exact(self, at: np.ndarray) -> np.ndarray:
        """Unit vectors, in double precision, of the rows with a direction."""
        return self.m[self.some[at]].astype(np.float64) / self.norms[at, None]

    def _pairs(self, rows: np.ndarray, cols: np.ndarray, qu: np.ndarray) -> np.ndarray:
        step = max(1, min(SCORE_BYTES // (16 * qu.shape[1]), 512))
        out = [np.einsum("ij,ij->i", self.m[self.some[rows[lo:lo + step]]].astype(np.float64), qu[cols[lo:lo + step]])
               / self.norms[rows[lo:lo + step]] for lo in range(0, len(rows), step)]
        # Similarities are compared at 12 decimals, so mathematically equal
        # scores tie (then the id decides) whatever the order of summation.
        return np.round(np.concatenate(out), SIM_DECIMALS) if out else np.zeros(0)

    def _able(self, boxes: slice, q32: np.ndarray, at: np.ndarray, slack: float) -> np.ndarray:
        """Which queries a box can hold a row with the similarity ``at`` or more for: ``(boxes x queries)``."""
        bound = self.high[boxes] @ np.maximum(q32, 0).T
        if q32.min() < 0:
            bound += self.low[boxes] @ np.minimum(q32, 0).T
        return bound + (slack * np.maximum(1, self.wide[boxes]))[:, None] >= at[None, :]

    def best(self, q: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query, similarity, row)`` of the first k rows per query; -inf is NULL. Rows that
        are less similar than ``least`` (-inf: any) may be left out.

        Boxes that cannot hold one of them are passed over; of the others single precision
        tells which rows can be among them, and those are compared in double."""
        qu, q_ok = unit_rows(q)
        on = np.flatnonzero(q_ok)
        qu = qu[on]
        q32, slack = qu.astype(np.float32), np.float32((q.shape[1] + 8) * 1.2e-7)
        acc = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]    # rows by their place in the order of the ids
        kth = np.full(len(on), -np.inf) if least is None else least[on]      # k-th similarity so far
        most = max(1, min(SCORE_BYTES // (8 * max(len(on), q.shape[1], 1)), TILE_ROWS))
        box, lo, size = 0, 0, min(most, max(4 * k, 256))
        while box < len(self.ends) and len(on):
            to = max(box + 1, int(np.searchsorted(self.ends, lo + size, side="right")))
            n, at = int(self.ends[to - 1]) - lo, (kth - slack).astype(np.float32)
            able = self._able(slice(box, to), q32, at, slack) if np.isfinite(kth).all() else None
            if able is None or np.count_nonzero(able) > DENSE_SHARE * able.size:
                s = self.unit[lo:lo + n] @ q32.T
                if n > k and able is None:
                    at = (np.maximum(kth, np.partition(s, n - k, axis=0)[n - k] - slack) - slack).astype(np.float32)
                hits = np.flatnonzero(s >= at[None, :])
                rows, cols = np.divmod(hits, len(on))
                if len(rows) > PAIR_SHARE * s.size and n > k:
                    # Nearly all are candidates (copies, few rows): the whole matrix in double precision.
                    d = np.round(self.exact(np.arange(lo, lo + n)) @ qu.T, SIM_DECIMALS)
                    rows, cols = np.nonzero(d >= np.maximum(np.partition(d, n - k, axis=0)[n - k], kth))
                    new = d[rows, cols]
                    del d
                else:
                    keep = likely(cols, s.ravel()[hits], k, slack)
                    rows, cols = rows[keep], cols[keep]
                    new = self._pairs(rows + lo, cols, qu)
            else:
                found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
                for i in np.flatnonzero(able.any(axis=1)).tolist():
                    own = np.flatnonzero(able[i])
                    first, end = (int(self.ends[box + i - 1]) if box + i else 0) - lo, int(self.ends[box + i]) - lo
                    s = self.unit[lo + first:lo + end] @ q32[own].T
                    hits = np.flatnonzero(s >= at[None, own])
                    found.append((hits // len(own) + first, own[hits % len(own)], s.ravel()[hits]))
                rows, cols, s = (np.concatenate(x) for x in zip(*found, strict=True))
                keep = likely(cols, s, k, slack)
                rows, cols = rows[keep], cols[keep]
                new = self._pairs(rows + lo, cols, qu)
            acc = [np.concatenate(x) for x in zip(acc, (cols, new, self.some[rows + lo]), strict=True)]
            keep = local_topk(*acc, k)
            acc = [x[keep] for x in acc]
            full = np.bincount(acc[0], minlength=len(on)) == k
            last = np.flatnonzero(np.r_[np.diff(acc[0]) != 0, True]) if len(keep) else np.zeros(0, np.int64)
            own = acc[0][last]
            kth[own[full[own]]] = np.maximum(kth[own[full[own]]], acc[1][last][full[own]])
            box, lo, size = to, lo + n, min(most, 2 * size)
        cols, sim, rows = on[acc[0]], acc[1], acc[2]
        # Pairs without a similarity come last, in the order of the ids.
        lack = k - np.bincount(cols, minlength=len(q))
        if least is not None:
            lack[np.isfinite(least)] = 0
        none = [(i, self.zero[:lack[i]] if q_ok[i] else np.arange(min(k, len(self.m))))
                for i in np.flatnonzero((lack > 0) & (~q_ok | (len(self.zero) > 0))).tolist()]
        return (np.concatenate([cols, *[np.full(len(r), i, np.int64) for i, r in none]]),
                np.concatenate([sim, *[np.full(len(r), -np.inf) for _, r in none]]),
                np.concatenate([rows, *[r for _, r in none]]))


class Group:
    """The cells of a part."""

    def __init__(self, cells: dict[int, tuple[list[pa.Array], list[np.ndarray]]]):
        self.parts = {c: Part(pa.concat_arrays(ids), np.concatenate(mats)) for c, (ids, mats) in cells.items()}
        self.first = dict(zip(self.parts, np.cumsum([0, *(len(p.ids) for p in self.parts.values())]).tolist()))
        self.ids = pa.concat_arrays([p.ids for p in self.parts.values()])
        self.cells = np.repeat(np.array(list(self.parts), np.int32), [len(p.ids) for p in self.parts.values()])    # of each row
        order = pc.sort_indices(self.ids, null_placement="at_start").to_numpy()
        self.place = np.empty(len(order), np.int64)            # of each row in the order of the ids
        self.place[order] = np.arange(len(order))

    def best(self, q: np.ndarray, cell: int, needs: np.ndarray, k: int,
             least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``Part.best``, over the cells from ``cell`` on that each query needs."""
        out = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        for i in range(needs.shape[1]):
            part, rows = self.parts.get(cell + i), np.flatnonzero(needs[:, i])
            if part is not None and len(rows):
                cols, sim, at = part.best(q[rows], k, None if least is None else least[rows])
                out.append((rows[cols], sim, at + self.first[cell + i]))
        cols, sim, at = (np.concatenate(x) for x in zip(*out, strict=True))
        keep = local_topk(cols, sim, self.place[at], k)
        return cols[keep], sim[keep], at[keep]


def scores(met: DataFrame, k: int, dim: int, doc_kind: str, query_kind: str) -> DataFrame:
    """Rows of parts, each part's blocks before its packs -> each part's ``k`` best per
    query: ``(qid, doc_id, similarity, cell)``. One part is held at a time."""
    id_type = met.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cells, part = None, {}, None
        for b in batches:
            for i, key in enumerate(b.column(0).to_pylist()):
                if key != now:
                    now, cells, part = key, {}, None
                data, cell = b.column(7)[i].as_buffer(), b.column(2)[i].as_py()
                if not b.column(1)[i].as_py():
                    ids, mats = cells.setdefault(cell, ([], []))
                    ids.append(pa.concat_arrays([b.column(3).slice(i, 1).flatten()]))
                    mats.append(np.frombuffer(data, doc_kind).reshape(-1, dim).copy())
                    continue
                if part is None:
                    if not cells:
                        continue
                    part, cells = Group(cells), {}
                qid = b.column(4).slice(i, 1).flatten().to_numpy(zero_copy_only=False)
                needs = np.frombuffer(b.column(5)[i].as_buffer(), bool).reshape(len(qid), -1)
                least = np.frombuffer(b.column(6)[i].as_buffer(), np.float64) if b.column(6)[i].is_valid else None
                cols, sim, rows = part.best(np.frombuffer(data, query_kind).reshape(-1, dim), cell, needs, k, least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qid[cols]), part.ids.take(pa.array(rows)), pa.array(sim, mask=np.isneginf(sim)), pa.array(part.cells[rows])],
                    ["qid", "doc_id", "similarity", "cell"])
    return met.select("part", "asks", "cell", "ids", "qids", "needs", "least", "data").mapInArrow(
        run, f"qid long, doc_id {id_type}, similarity double, cell int")


def first_k(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc_nulls_last("similarity"), F.asc("doc_id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def meet(stored: DataFrame, packed: DataFrame, cells: Cells, part_rows: int, lanes: int) -> DataFrame:
    """Blocks and packs dealt by part and lane: ``(part, asks, cell, ids, qids, needs, least, data)``
    rows in the order of the parts, a part's blocks before its packs."""
    starts, numbers, parts = part_numbers(cells, part_rows)
    # At most MAX_CELLS + 1 numbers each, as literals.
    first, n = (F.get(F.from_json(F.lit(str(x.tolist())), "array<bigint>"), F.col("cell")) for x in (starts, numbers))
    docs = stored.select((first + F.pmod(F.col("share").cast("long"), n)).alias("part"),
                         F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(False).alias("asks"), "cell", "ids",
                         F.lit(None).cast("array<bigint>").alias("qids"), F.lit(None).cast("binary").alias("needs"), F.lit(None).cast("binary").alias("least"), "data")
    asks = packed.select((first + F.col("share")).alias("part"), "lane", F.lit(True).alias("asks"), "cell",
                         F.lit(None).cast(stored.schema["ids"].dataType).alias("ids"), "qids", "needs", "least", F.col("qdata").alias("data"))
    tasks = int(min(parts * lanes, 10_000))
    both = docs.unionByName(asks).withColumn("part", F.col("part") * lanes + F.col("lane")).drop("lane")
    return both.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part", "asks")


def search(stored: DataFrame, queries: DataFrame, cells: Cells, k: int, dim: int, block_rows: int,
           doc_kind: str, n_probe: int | None, rest: bool = False, *, asked: int) -> DataFrame:
    """Top-k of the queries (``asked`` of them) over the blocks of the cells that they need (see ``packs``)."""
    rows, lanes = grid(cells, dim, block_rows, slots(stored), doc_kind, asked, cells.n + 1 if rest or n_probe is None else n_probe)
    met = meet(stored, packs(queries, cells, dim, rows, n_probe, rest, lanes, together=True), cells, rows, lanes)
    return first_k(scores(met, k, dim, doc_kind, vector_type(queries)), k)


def search_pruned(stored: DataFrame, queries: DataFrame, cells: Cells, k: int, dim: int, block_rows: int,
                  doc_kind: str, n_probe: int, *, asked: int) -> DataFrame:
    """Exact top-k: the nearest cells give each query its k-th similarity so far,
    then only cells whose bound reaches it are visited."""
    if n_probe >= cells.n:
        return search(stored, queries, cells, k, dim, block_rows, doc_kind, None, asked=asked)
    near = saved(search(stored, queries, cells, k, dim, block_rows, doc_kind, n_probe, asked=asked), "topk-near")
    kth = near.where(F.col("rank") == k).select("qid", F.col("similarity").alias("thr"))
    # As many rows as queries: merged, not gathered on the driver for a broadcast.
    rest = search(stored, queries.join(kth.hint("merge"), "qid", "left"), cells, k, dim, block_rows, doc_kind, n_probe, rest=True, asked=asked)
    return first_k(near.unionByName(rest).drop("rank"), k)
