"""Spark session settings shared by the library, tests and bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC timestamps (oracle parity), AQE for runtime
# re-planning and skew splitting, last-wins map keys (H6, R6 merge semantics).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # pages that a Python worker holds at a time, by number and bytes: 10,000 of them are hundreds of MB there
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # streams: repeats of a session meet before the shuffle, and state files (whole pages, in detection) are packed well
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "sitelens") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("SITELENS_DRIVER_MEMORY", "16g"))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session-level SQL settings to an existing session (driver-given sessions)."""
    for k, v in DEFAULT_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def session_key(spark: SparkSession) -> str:
    """Stable identity of a live session (an object id can be reused after a session stops)."""
    return f"{spark.sparkContext.applicationId}/{spark.sparkContext.startTime}/{id(spark)}"


def ship_package(spark: SparkSession) -> None:
    """Make ``sitelens`` importable on executors (pandas UDFs reference its modules).

    The package is zipped once per driver process and distributed with addPyFile,
    the same as ``--py-files`` on spark-submit.
    """
    sc = spark.sparkContext
    if session_key(spark) in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="sitelens-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "sitelens"), "zip", os.path.dirname(pkg), "sitelens")
    sc.addPyFile(archive)
    _SHIPPED.add(session_key(spark))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder; only single-process (local) sessions get one of our own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="sitelens-ckpt-")
    sc.setCheckpointDir(local)
    return local
