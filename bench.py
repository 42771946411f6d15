"""Headline-query benchmark: prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
After an untimed session start-up step (Python worker pool), every query is
planned and fully executed into Spark's no-op sink twice: the first (cold) run
pays JVM code generation / JIT for its own code paths,
the warm time is the best of two further runs (steady state; timings on a
shared host are noisy). Retrieval and dialogue run on a knowledge base stored before;
``kb_ingest`` times storing it. ``value`` and ``queries`` are the warm times;
``cold`` lists the first runs.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kbweave.config import get_session  # noqa: E402
from kbweave.plans import catalog  # noqa: E402

HEADLINE = ["topk_batch", "topk_blocked", "topk_text", "kb_ingest", "topk_stored", "hash_embed", "kb_documents", "history_window",
            "stream_history", "kb_atomic", "page_sections", "dialog_answers"]
STORED = {"topk_stored", "dialog_answers"}      # timed on a knowledge base that an ingest has stored


def _run(name: str, sf_dir: str, spark, kb) -> float:
    t0 = time.perf_counter()
    if name == "kb_ingest":                     # pages -> entries -> embedded rows, written
        catalog._kb(spark, sf_dir)
    else:
        df = catalog.QUERIES[name](spark, sf_dir, kb) if name in STORED else catalog.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
    took = round(time.perf_counter() - t0, 3)
    spark.catalog.clearCache()             # no run profits from an earlier one
    return took


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", app="kbweave-bench", shuffle_partitions=cpus)
    scratch = tempfile.mkdtemp(prefix="kbweave-bench-")
    spark.sparkContext.setCheckpointDir(scratch)
    # Session start-up (untimed): start the Python worker pool once with a tiny
    # Arrow step, so the first query's cold time is its own.
    (spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id")
     .mapInPandas(lambda it: it, "item_id long").write.format("noop").mode("overwrite").save())
    spark.conf.set("kbweave.scan.partitions", str(cpus))     # the tables are one row group each
    cold, warm, kb = {}, {}, None
    for name in HEADLINE:
        if name in STORED and kb is None:
            kb = catalog._kb(spark, sf_dir)
        cold[name] = _run(name, sf_dir, spark, kb)
        warm[name] = min(_run(name, sf_dir, spark, kb) for _ in range(2))
    spark.stop()
    shutil.rmtree(scratch, ignore_errors=True)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_warm_total_sec", "value": round(sum(warm.values()), 3),
                      "warm": "best of 2 runs after one cold run",
                      "unit": "sec", "queries": warm, "cold": cold,
                      "cold_total_sec": round(sum(cold.values()), 3), "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
