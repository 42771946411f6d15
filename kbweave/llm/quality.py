"""Quality classifier: interpolated modified Kneser-Ney model of trusted text.

The model is over bytes (order 5 by default): its grams are exact integer keys,
every language and script fits, and a partition of text has few distinct grams,
so counts are merged per task before any shuffle.

1. Each task counts the grams of its text, and the counts of all and of trusted
   text are summed by gram. Trusted text is found by a join with the labels, before
   which a semi-join on a bounded number of hash buckets keeps other text in place.
2. Per order, continuation counts, discounts, context sums and interpolated
   probabilities are joins of count tables sharded by gram, context or suffix.
   They run over every distinct gram of the corpus, seen in trusted text or not.
3. Scoring reads each document once. The most frequent grams are looked up in a
   direct-mapped table of fixed size that is broadcast; any other gram of a
   document is joined, with its count, to the sharded probability table and
   summed per document. Both ways give the same numbers.
4. A language's threshold is a quantile of the perplexities of its trusted
   documents in a fold that the model was not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbweave.llm.common import give_back, saved, text_bytes
from kbweave.llm.textvec import slices

ORDER = 5
FOLDS = 5
HEAD_SLOTS = 1048573     # slots (a prime) of the broadcast table: 16 bytes each, whatever the corpus
ID_BUCKETS = 1 << 20     # hash buckets of trusted ids broadcast at most
TILE = 1 << 19           # bytes of text whose grams are made at once
FLUSH = 1 << 21          # distinct grams a task holds before it passes them on
TRUST, CALIBRATE, OTHER = 2, 1, 0


def grams(buf: np.ndarray, off: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The gram that ends at each byte (the byte lowest); zero bytes stand before a text."""
    place = np.arange(len(buf)) - np.repeat(off[:-1], np.diff(off))
    code = buf.astype(np.uint64)
    for k in range(1, order):
        before = np.zeros(len(buf), np.uint64)
        before[k:] = buf[:-k] if k < len(buf) else 0
        before[place < k] = 0
        code |= before << np.uint64(8 * k)
    return code


def _merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g = np.concatenate([p[0] for p in parts])
    u, at = np.unique(g, return_inverse=True)
    total, trusted = (np.bincount(at, np.concatenate([p[i] for p in parts]), len(u)).astype(np.int64) for i in (1, 2))
    return u, total, trusted


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``docs(text, fold)`` -> ``(g, total, trusted)`` over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for b in batches:
            for at, to in slices(b, 0, TILE):
                part = b.slice(at, to - at)
                buf, off = text_bytes(part.column(0))
                train = np.repeat(part.column(1).to_numpy(zero_copy_only=False) == TRUST, np.diff(off))
                g = grams(buf, off, order)
                u, inv = np.unique(g, return_inverse=True)
                held.append((u, np.bincount(inv, minlength=len(u)), np.bincount(inv, train, len(u))))
                size += len(u)
                if size > FLUSH:
                    held = [_merge(held)]
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        yield _rows(held[0])
                        held, size = [], 0
        if held:
            yield _rows(_merge(held))
        held.clear()
        give_back()

    def _rows(m):
        return pa.RecordBatch.from_arrays([pa.array(m[0].view(np.int64)), pa.array(m[1]), pa.array(m[2])],
                                          ["g", "total", "trusted"])

    counted = docs.select("text", "fold").mapInArrow(run, "g long, total long, trusted long")
    return counted.groupBy("g").agg(F.sum("total").alias("total"), F.sum("trusted").alias("trusted"))


def _discounts(table: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more."""
    n = {r["k"]: r["n"] for r in table.groupBy(F.least("c", F.lit(5)).alias("k")).agg(F.count("*").alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5

    def d(k, a, b):
        return min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) if a else k * 0.5
    return d(1, n1, n2), d(2, n2, n3), d(3, n3, n4)


def _suffix(order: int):
    return F.col("g").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))


def gram_probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``(g, total, lp)``: natural log probability of a gram's last byte after
    the others, for every gram of the corpus."""
    context = F.shiftrightunsigned("g", 8)
    seen = {order: counts.where("trusted > 0").select("g", F.col("trusted").alias("c"))}
    want = {order: counts.select("g")}
    for n in range(order - 1, 0, -1):
        seen[n] = saved(seen[n + 1].groupBy(_suffix(n + 1).alias("g")).agg(F.count("*").alias("c")), "kn-seen")
        want[n] = want[n + 1].select(_suffix(n + 1).alias("g")).distinct()
    lower = None
    for n in range(1, order + 1):
        d1, d2, d3 = _discounts(seen[n])
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        ctx = seen[n].groupBy(context.alias("ctx")).agg(
            F.sum("c").cast("double").alias("s"), F.sum(off).alias("held"))
        w = want[n].join(seen[n], "g", "left").withColumn("ctx", context).withColumn("low", _suffix(n))
        w = w.join(ctx, "ctx", "left")
        if lower is None:
            w = w.withColumn("lower_p", F.lit(1 / 256))
        else:
            w = w.join(lower.select(F.col("g").alias("low"), F.col("p").alias("lower_p")), "low")
        p = F.when(F.col("s").isNull(), F.col("lower_p")).otherwise(
            (F.when(F.col("c").isNull(), 0.0).otherwise(F.col("c") - off) + F.col("held") * F.col("lower_p")) / F.col("s"))
        lower = saved(w.select("g", p.alias("p")), "kn-p")
    return saved(counts.join(lower, "g").select("g", "total", F.log("p").alias("lp")), "kn-lp")


def _slot(g: np.ndarray, slots: int) -> np.ndarray:
    return (g % np.uint64(slots)).astype(np.int64)


def head_table(probs: DataFrame, slots: int = HEAD_SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Direct-mapped table of ``slots`` grams: of those that share a slot the
    most frequent one; the others are joined."""
    top = probs.groupBy((F.col("g") % slots).alias("slot")).agg(F.max(F.struct("total", "g", "lp")).alias("x")).select(
        "slot", "x.g", "x.lp").toArrow()
    key = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    val = np.zeros(slots)
    at = top.column("slot").to_numpy()
    key[at], val[at] = top.column("g").to_numpy().view(np.uint64), top.column("lp").to_numpy()
    return key, val


def _score(docs: DataFrame, probs: DataFrame, order: int, slots: int) -> DataFrame:
    """``(id, lang, fold, n, lp)`` per row of ``docs(id, lang, fold, text)``."""
    table = docs.sparkSession.sparkContext.broadcast(head_table(probs, slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, val = table.value
        for b in batches:
            for at, to in slices(b, 2, TILE):
                part = b.slice(at, to - at)
                buf, off = text_bytes(part.column(2))
                n_row = len(off) - 1
                g = grams(buf, off, order)
                row = np.repeat(np.arange(n_row), np.diff(off))
                slot = _slot(g, slots)
                hit = key[slot] == g
                lp = np.bincount(row[hit], val[slot[hit]], n_row).astype(np.float64)     # whole numbers, if nothing hits
                miss = np.flatnonzero(~hit)
                miss = miss[np.lexsort((g[miss], row[miss]))]
                r, m = row[miss], g[miss]
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(m)), bool), (r[1:] != r[:-1]) | (m[1:] != m[:-1]))))
                times = np.diff(np.append(first, len(m)))
                ends = np.concatenate(([0], np.cumsum(np.bincount(r[first], minlength=n_row)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(off)), pa.array(lp),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(m[first].view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32)))],
                    ["id", "lang", "n", "lp", "g", "times"])
        give_back()

    t = docs.schema["id"].dataType.simpleString()
    scored = docs.select("id", "lang", "text").mapInArrow(
        run, f"id {t}, lang string, n long, lp double, g array<long>, times array<int>")
    scored = saved(scored.withColumn("key", F.monotonically_increasing_id()), "kn-scored")
    rest = (scored.where(F.size("g") > 0).select("key", F.explode(F.arrays_zip("g", "times")).alias("x"))
            .select("key", F.col("x.g").alias("g"), F.col("x.times").alias("times")))
    rest = (rest.join(probs.select("g", F.col("lp").alias("glp")), "g")
            .groupBy("key").agg(F.sum(F.col("times") * F.col("glp")).alias("more")))
    return (scored.select("key", "id", "lang", "n", "lp").join(rest, "key", "left")
            .select("id", "lang", "n", (F.col("lp") + F.coalesce("more", F.lit(0.0))).alias("lp")))


def perplexities(docs: DataFrame, labels: DataFrame, order: int = ORDER, slots: int = HEAD_SLOTS, id_col: str = "doc_id",
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id, lang, n, perplexity, fold)`` per row; ``fold`` is 2 for text the
    model was trained on, 1 for trusted text held out, else 0."""
    trusted = (labels.groupBy(F.col("doc_id").alias("lid"))
               .agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
               .where("lid is not null and q = 1 and t = 0")
               .select("lid", F.when(F.pmod(F.xxhash64("lid"), F.lit(FOLDS)) == 0, CALIBRATE).otherwise(TRUST).alias("fold")))
    src = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                      F.col(text_col).cast("string").alias("text"))
    # Only text that may be trusted moves to its label: its id's hash bucket is one of a trusted id's.
    bucket = F.pmod(F.xxhash64("id"), F.lit(ID_BUCKETS))
    train = trusted.where(F.col("fold") == TRUST)
    own = train.select(F.pmod(F.xxhash64("lid"), F.lit(ID_BUCKETS)).alias("bucket")).distinct()
    likely = src.select("id", "text", bucket.alias("bucket")).join(F.broadcast(own), "bucket", "left_semi")
    marked = likely.join(train.hint("merge"), likely["id"] == train["lid"]).select("text", "fold")
    everything = src.select("text", F.lit(OTHER).alias("fold"))
    counts = count_grams(everything, order).select("g", "total").join(
        count_grams(marked, order).select("g", "trusted"), "g", "left").select(
        "g", "total", F.coalesce("trusted", F.lit(0)).alias("trusted"))
    probs = gram_probabilities(saved(counts, "kn-counts"), order)
    scored = _score(src, probs, order, slots)
    return scored.join(trusted, scored["id"] == trusted["lid"], "left").select(
        "id", "lang", "n", F.when(F.col("n") > 0, F.exp(-F.col("lp") / F.col("n"))).alias("perplexity"),
        F.coalesce("fold", F.lit(OTHER)).alias("fold"))


def quality_classifier(docs: DataFrame, labels: DataFrame, quantile: float = 0.95, slack: float = 1.05,
                       margin: float = 2.0, least_trusted: int = 20, order: int = ORDER, slots: int = HEAD_SLOTS, id_col: str = "doc_id",
                       text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id_col, lang, n_bytes, perplexity, threshold, kept)``, one row per input row.

    Trusted: every label row of the id has quality 1 and none toxic 1; rows with a
    null id or label id match nothing. ``threshold`` is the ``quantile`` of the
    held-out trusted perplexities of the language times ``slack``. A text is kept
    up to ``threshold * exp(margin / sqrt(bytes))``: the mean of few bytes is a
    noisy figure, which alone is no ground to reject a short text. A language
    (null is one) with fewer than ``least_trusted`` of them takes the quantile over
    all. Without any the threshold is null and nothing is rejected for its
    perplexity. Null or empty text has no perplexity and is not kept. Repeated
    rows score alike; an empty table gives no rows; other columns are ignored."""
    p = saved(perplexities(docs, labels, order, slots, id_col, text_col, lang_col), "kn-perplexity")
    held = p.where((F.col("fold") == CALIBRATE) & F.col("perplexity").isNotNull())
    at = F.percentile_approx("perplexity", quantile, 100_000)
    overall = held.agg(at.alias("all_t"))
    by_lang = held.groupBy("lang").agg(at.alias("lang_t"), F.count("*").alias("trusted")).where(
        F.col("trusted") >= least_trusted).select(F.col("lang").alias("_lang"), "lang_t")
    out = p.join(by_lang, p["lang"].eqNullSafe(by_lang["_lang"]), "left").withColumn("all_t", overall.scalar())
    out = out.withColumn("threshold", F.coalesce("lang_t", "all_t") * slack)
    return out.select(F.col("id").alias(id_col), F.col("lang"), F.col("n").alias("n_bytes"), "perplexity", "threshold",
                      (F.col("perplexity").isNotNull()
                       & F.coalesce(F.col("perplexity") <= F.col("threshold") * F.exp(margin / F.sqrt("n")), F.lit(True)))
                      .alias("kept"))


def drop_rejected(docs: DataFrame, verdict: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id has a kept verdict row (all columns)."""
    ok = verdict.where("kept").select(F.col(id_col).alias("_ok")).distinct()
    return docs.join(ok, docs[id_col].eqNullSafe(ok["_ok"]), "left_semi")
