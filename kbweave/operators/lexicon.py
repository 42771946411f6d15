"""Intent classification with a large keyword table in one pass over each text.

The keywords of a part of the table form one Aho-Corasick automaton, which reads a text
once whatever the number of keywords. Parts are of bounded size; keywords and texts are
dealt to tasks by part, a task's keywords first, so a task holds one part and nothing of
the table passes through the driver. A text takes the intent of its first-priority keyword.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbweave.operators.hashing import sliced
from kbweave.operators.partitioning import saved

MAX_BYTES = 4 << 20       # of the keywords of a part, 16 bytes added for each


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(part, asks, id, text, priority, intent)``, a part's keywords before its texts -> ``(id, priority, intent)``."""
    import ahocorasick
    now, best, automaton = None, {}, None
    for whole in batches:
        for b in sliced(iter([whole.to_struct_array()])):
            out = []
            for r in b.to_pylist():
                if r["part"] != now:
                    now, best, automaton = r["part"], {}, None
                if not r["asks"]:
                    word = (r["priority"], r["intent"])
                    if r["text"] not in best or word < best[r["text"]]:
                        best[r["text"]] = word
                    continue
                if automaton is None:
                    automaton = ahocorasick.Automaton()
                    for k, v in best.items():
                        automaton.add_word(k, v)
                    automaton.make_automaton()
                    best = {}
                hit = min((v for _, v in automaton.iter(r["text"])), default=None) if len(automaton) else None
                if hit is not None:
                    out.append({"_id": r["_id"], "priority": hit[0], "intent": hit[1]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("_id", pa.int64()), ("priority", pa.int64()), ("intent", pa.string())]))


def classify_by_lexicon(df: DataFrame, lexicon: DataFrame, text: str = "text", out: str = "cls",
                        max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds ``out``: ``STRUCT<intent_type, intent, requires_search>`` as ``dialog.classify``
    gives it, for a lexicon table ``(priority, intent, keyword)`` of any length. A
    keyword matches as a case-sensitive substring; the smallest priority wins, then the
    smallest intent. A lexicon of more than ``max_bytes`` is cut into parts by a hash
    of the keyword, each an automaton of its own; null and empty keywords match nothing."""
    own = saved(lexicon.where(F.col("keyword").isNotNull() & (F.col("keyword") != "")).select(
        F.col("keyword").cast("string"), F.col("priority").cast("long"), F.col("intent").cast("string")), "lexicon")
    size = own.agg(F.sum(F.octet_length("keyword") + 16)).first()[0] or 0
    parts = max(1, -(-size // max_bytes))
    # With few parts each is given to several tasks, which share its texts.
    deals = max(1, -(-2 * df.sparkSession.sparkContext.defaultParallelism // parts))
    rows = saved(df.withColumn("_id", F.monotonically_increasing_id()), "lexicon-texts")
    part = F.pmod(F.xxhash64("keyword"), F.lit(parts))
    words = own.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(deals - 1)), lambda x: x + part * deals)).alias("part"), F.lit(False).alias("asks"),
                       F.lit(None).cast("long").alias("_id"), F.col("keyword").alias("text"), "priority", "intent")
    deal = F.pmod(F.xxhash64("_id"), F.lit(deals))
    asks = rows.where(F.col(text).isNotNull() & (F.col(text) != "")).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda x: x * deals + deal)).alias("part"),
        F.lit(True).alias("asks"), "_id", F.col(text).alias("text"),
        F.lit(None).cast("long").alias("priority"), F.lit(None).cast("string").alias("intent"))
    tasks = parts * deals
    met = words.unionByName(asks).repartitionById(tasks, F.col("part").cast("int")).sortWithinPartitions("part", "asks")
    hits = met.mapInArrow(_hits, "_id long, priority long, intent string")
    first = hits.groupBy("_id").agg(F.min(F.struct("priority", "intent"))["intent"].alias("_intent"))
    named = rows.join(first, "_id", "left")
    cls = F.struct(F.when(F.col("_intent").isNull(), "business").otherwise("conversational").alias("intent_type"),
                   F.col("_intent").alias("intent"), F.col("_intent").isNull().alias("requires_search"))
    return named.withColumn(out, cls).select(*df.columns, out)
