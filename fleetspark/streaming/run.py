"""Running a stream over all present input into a table."""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from fleetspark.sources.shared_files import SharedFolder
from fleetspark.streaming.builds import ROCKSDB
from fleetspark.streaming.flows import newest_checks

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"


def start_to_files(stream: DataFrame, out: str, checkpoint: str):
    """Append stream to Parquet files, up to the input present now."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


@contextmanager
def stream_settings(spark: SparkSession, partitions: int):
    """Settings a stream takes over when it starts; the session gets its own back.

    State lies in RocksDB, outside the executor heap.  A stream keeps its number of
    state partitions for life and pays for each in every batch, so the caller states
    it: about the cores of the cluster at its full size.
    """
    wanted = {PROVIDER: ROCKSDB, PARTITIONS: str(partitions)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_to_table(stream: DataFrame, root: str, partitions: int) -> DataFrame:
    """Run a stream over all present input; the result is read back from files below ``root``."""
    spark = stream.sparkSession
    with stream_settings(spark, partitions):
        query = start_to_files(stream, f"{root}/rows", f"{root}/checkpoint")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


class HealthState:
    """Current health per client: a base and a log of the changed clients of each stream batch since.

    Only changes are written, so a batch costs what it changes, not the size of the fleet.  Every
    ``compact_every`` batches the state so far becomes a new base.  It counts from the moment a small
    file names it; a crash before leaves the old base and the whole log.  The base before and its log
    stay until the next compaction, for readers that still hold them, so the folder keeps at most two
    bases and twice ``compact_every`` parts.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, compact_every: int = 50):
        self.spark, self.root, self.schema, self.compact_every = spark, root.rstrip("/"), schema, compact_every
        self.folder = SharedFolder(spark, self.root)
        self._logged = StructType([*schema.fields]).add("batch", LongType())

    def upsert(self, changes: DataFrame, batch_id: int) -> None:
        # A repeated batch overwrites its own part of the log; one that is in the base already is not read.
        changes.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.root}/log/{batch_id:012d}")
        if (batch_id + 1) % self.compact_every == 0:
            self.compact(batch_id)

    def bases(self) -> list[int]:
        """Last batches of the present base and, if kept, of the one before: newest first."""
        return json.loads(self.folder.read("bases.json")) if self.folder.exists("bases.json") else []

    def compact(self, upto: int) -> None:
        """Make the state after batch ``upto`` the base."""
        known = self.bases()
        if known and upto <= known[0]:
            return
        self._state(upto).write.mode("overwrite").parquet(f"{self.root}/base/{upto:012d}")
        self.folder.publish("bases.json", json.dumps([upto, *known[:1]]), replace=True)
        oldest = known[0] if known else -1
        for name in self.folder.names("base"):
            if int(name) < oldest:
                self.folder.delete(f"base/{name}")
        for name in self.folder.names("log"):
            if int(name) <= oldest:
                self.folder.delete(f"log/{name}")

    def _state(self, upto: int | None = None) -> DataFrame:
        """Base and log as one row per client, with the batch of its last change."""
        base = self.bases()[:1]
        parts = [n for n in self.folder.names("log") if n.isdigit() and (not base or int(n) > base[0]) and (upto is None or int(n) <= upto)]
        paths = [f"{self.root}/base/{b:012d}" for b in base] + [f"{self.root}/log/{n}" for n in parts]
        if not paths:
            return self.spark.createDataFrame([], self._logged)
        rows = self.spark.read.schema(self._logged).parquet(*paths)
        keyed = rows.select("batch", "client_id", F.struct(*self._logged.fieldNames()).alias("_row"))
        return keyed.groupBy("client_id").agg(F.max_by("_row", "batch").alias("_row")).select("_row.*")

    def current(self) -> DataFrame:
        """The last change of every client, from the folder alone; empty before the first batch."""
        return self._state().drop("batch")


def latest_health_stream(checks: DataFrame, root: str, partitions: int, compact_every: int = 50) -> DataFrame:
    """Run a stream of checks over all present input; the current check of every client.

    Run again on the same ``root`` it goes on where it stopped, with or without new input.
    """
    spark = checks.sparkSession
    newest = newest_checks(checks)
    state = HealthState(spark, f"{root}/state", newest.schema, compact_every)
    with stream_settings(spark, partitions):
        query = (
            newest.writeStream.outputMode("update").foreachBatch(state.upsert).option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return state.current()
