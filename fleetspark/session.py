"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# SQL settings the library is tuned for.  They are safe defaults for a cluster:
# AQE sizes partitions and splits skewed joins, also where that costs one more
# shuffle, and a file split stays small enough to sort in executor memory.
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def build_session(app_name: str = "fleetspark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SQL_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_local_root: str | None = None


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for one run's tables, snapshots or stream state.

    It lies in the shared folder that ``spark.checkpoint.dir`` names.  Where the
    setting is absent only a local session may go on, with a temporary folder.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local_root = root = _local_root or tempfile.mkdtemp(prefix="fleetspark-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
