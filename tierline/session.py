"""Session construction and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of ours needs for correct results, whatever the
# cluster defaults are: instants are interpreted in UTC.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Defaults for sessions we build ourselves (tests, bench). On a cluster the
# operator's spark-defaults win for everything but REQUIRED_CONF.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.driver.memory": "8g",
}


# Settings this design assumes on a large cluster (apply in spark-defaults or
# pass to build_session). Partitions are sized by bytes, not counts: AQE starts
# from many shuffle partitions and coalesces them to ~256 MB, splits skewed
# join partitions, and scans read ~256 MB splits.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str = "local[8]", app: str = "tierline", **conf) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**LOCAL_CONF, **REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_session(spark)
    return spark


def ensure_session(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on to a session someone else built."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder every executor can reach, for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``; only when that is unset
    (local tests) do we create one under the system temp folder and register
    it, so later calls and ``DataFrame.checkpoint()`` agree.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not base and sc is not None:
        base = sc.getCheckpointDir()
    if not base and sc is not None and not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if not base:
        base = tempfile.mkdtemp(prefix="tierline-")
        spark.conf.set("spark.checkpoint.dir", base)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)       # so DataFrame.checkpoint() uses the same folder
    return "/".join([base.rstrip("/"), *parts]) if parts else base


def _context(spark: SparkSession):
    """The SparkContext of a classic session (None for a Spark Connect session)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        return None


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder (never reused or cleared)."""
    path = shared_dir(spark, "tierline", f"{label}-{uuid.uuid4().hex[:12]}")
    if path.startswith("file:"):
        local = path[len("file:"):]
        os.makedirs(os.path.dirname(local), exist_ok=True)
    elif path.startswith("/"):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    return path
