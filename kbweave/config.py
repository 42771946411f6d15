"""Job parameters and session helpers."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

# Fixed values that must equal the reference's for identical results.
DEFAULT_TOP_K = 3          # results returned per query
HISTORY_LEN = 6            # messages kept per conversation ("last 3 exchanges")
TRANSCRIPT_LEN = 3         # messages shown in the prompt, current one included
REQUIRED_ENTRY_FIELDS = ("title", "content", "links")
MODEL_ATTEMPTS = 3         # attempts around the model step
RETRY_WAIT_MIN_S = 4.0     # exponential wait, clamped to [4, 10] seconds
RETRY_WAIT_MAX_S = 10.0


@dataclass(frozen=True)
class Params:
    """Parameters of the jobs; nothing here is read from the environment."""

    top_k: int = DEFAULT_TOP_K
    dim: int = 64                      # stored vector dimension (1536 in production)
    text_dim: int = 256                # hashed term-frequency dimension for texts
    history_len: int = HISTORY_LEN
    transcript_len: int = TRANSCRIPT_LEN
    chunk_chars: int = 1000            # chunk size for text chunking
    run_ts: str = "2024-01-01 00:00:00"   # run timestamp used in source keys
    reader_prefix: str = "https://reader.invalid/"
    # Bytes of the vectors that a block of documents holds (one row of packed vectors).
    block_bytes: int = 8 * 1024 * 1024
    # Tasks that the pages of an ingest are dealt over; None keeps the scan's own splits.
    scan_partitions: int | None = None
    # Rows per block for the skew-safe bounded look-back windows.
    lookback_block_rows: int = 1_000_000
    # Keyed streaming state of a conversation is dropped after this much
    # processing time without new messages (bounds the state store).
    state_idle_ms: int = 30 * 60 * 1000


def get_session(master: str | None = None, app: str = "kbweave",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the jobs assume."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", "8g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from the session (``spark.checkpoint.dir``). Only a local master may
    leave it unset (tests) and gets a folder under the system temp dir; on a
    cluster that would be a different disk on every machine, so it is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = os.path.join(os.environ.get("TMPDIR", "/tmp"), "kbweave-ckpt")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Make ``kbweave`` importable in Python workers on every executor by
    shipping a zip of the package with the job (idempotent per context).

    The zip is a driver-side build artifact handed to ``addPyFile``; Spark
    distributes it, no data goes through it. Deployments that already pass
    the package with ``--py-files`` set ``kbweave.ship=false``."""
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_kbweave_shipped", False) or spark.conf.get("kbweave.ship", "true") == "false":
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, zpath = tempfile.mkstemp(prefix="kbweave-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            if "__pycache__" in d:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    sc._kbweave_shipped = True
