"""SparkSession helpers: one place for the configs every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Fixed session settings. Timestamps are compared in UTC (epoch-second rules),
# AQE re-plans joins and coalesces partitions at runtime, and skewed join
# partitions are split instead of landing in one task. On a cluster the
# launcher's session is used as it is; these are the settings to give it.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches handed to Python are bounded in bytes as well as rows, so
    # a batch of large file bodies cannot exhaust a Python worker
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "filelens", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one with :data:`BASE_CONF`.

    On a cluster the launcher supplies master and sizes; locally (tests, bench)
    ``master`` defaults to ``local[*]``.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("FILELENS_MASTER", "local[*]"))
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (the cluster names a shared, fault
    tolerant folder there). Only when it is unset on a local master (tests)
    a fresh scratch folder is created and registered; on a cluster an unset
    setting is an error, never a folder on the driver's disk.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            # executors cannot see a folder on the driver's disk
            raise RuntimeError("set spark.checkpoint.dir to a shared, fault-tolerant folder "
                               "(checkpoints and intermediate tables are written there)")
        d = tempfile.mkdtemp(prefix="filelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared checkpoint folder for a written table."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
