"""Spark session helpers.

Everything here is plain configuration; planning and execution stay with
Catalyst / AQE. The defaults are sized for tests on ``local[N]``; on a cluster
the caller's session (and its ``spark.checkpoint.dir``) is used unchanged.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this package relies on. Applied only when building a
# session ourselves (tests, bench); a cluster session keeps its own values.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # whole HTML pages per row: keep Arrow batches to the Python workers small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # map keys: duplicate <meta name> keeps the last value, as a dict() would
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "hemicycle") -> SparkSession:
    """Return the active session, or build a local one for tests / bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    builder = builder.config("spark.driver.memory", os.environ.get("HEMICYCLE_DRIVER_MEMORY", "4g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only where none is set.

    On a cluster ``spark.checkpoint.dir`` names a shared (distributed) folder
    and is used as is. Only a local session without that setting (tests) gets
    a fresh folder under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc._jsc.sc().isLocal():  # one process: there is no other machine to share a folder with
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="hemicycle-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder for written tables, next to the checkpoint folder (shared on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"
