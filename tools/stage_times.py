"""Per-stage timings from Spark's event log (no UI / REST involved).

    python tools/stage_times.py [--sf DIR] name [name ...]

Runs each query into the no-op sink with the event log written to a fresh
scratch folder, then prints, per stage: tasks, summed task run time, input
bytes, shuffle read/write bytes.
"""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from kbweave.config import ship_package  # noqa: E402
from kbweave.plans import catalog  # noqa: E402


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("names", nargs="+")
    a = ap.parse_args()
    logdir = tempfile.mkdtemp(prefix="kbweave-eventlog-")
    spark = (SparkSession.builder.master("local[8]").appName("kbweave-stages")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", logdir)
             .config("spark.eventLog.compress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    for n in a.names:
        spark.sparkContext.setJobGroup(n, n)
        catalog.QUERIES[n](spark, a.sf).write.format("noop").mode("overwrite").save()
    spark.stop()
    stages = {}
    for path in glob.glob(f"{logdir}/**/*", recursive=True):
        if os.path.isdir(path):
            continue
        with open(path) as f:
            for line in f:
                e = json.loads(line)
                if e.get("Event") != "SparkListenerTaskEnd":
                    continue
                sid = e["Stage ID"]
                m = e.get("Task Metrics") or {}
                s = stages.setdefault(sid, {"tasks": 0, "run_ms": 0, "in_b": 0, "shr_b": 0, "shw_b": 0})
                s["tasks"] += 1
                s["run_ms"] += m.get("Executor Run Time", 0)
                s["in_b"] += (m.get("Input Metrics") or {}).get("Bytes Read", 0)
                sr = m.get("Shuffle Read Metrics") or {}
                s["shr_b"] += sr.get("Remote Bytes Read", 0) + sr.get("Local Bytes Read", 0)
                s["shw_b"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
    print(f"{'stage':>5} {'tasks':>5} {'task_ms':>8} {'input_B':>11} {'shuf_read_B':>11} {'shuf_write_B':>12}")
    for sid in sorted(stages):
        s = stages[sid]
        print(f"{sid:>5} {s['tasks']:>5} {s['run_ms']:>8} {s['in_b']:>11} {s['shr_b']:>11} {s['shw_b']:>12}")
    print("event log:", logdir)


if __name__ == "__main__":
    main()
