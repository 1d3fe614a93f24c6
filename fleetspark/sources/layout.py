"""Tables laid out by client: joins and rankings by client read them without a shuffle.

Rows of a client lie in one of ``buckets`` bucket files, sorted by time.  A bucket is read by one
task, so a client with very many rows must not lie in one: clients with over ``hot_rows`` rows in
any table, and rows without client, go to plain files beside the buckets.  A view that treats
clients one by one is the union of the view over both parts.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspark.plans.hot_keys import HOT_ROWS, SURE_ROWS
from fleetspark.sources.shared_files import SharedFolder


@dataclass(frozen=True)
class Clustering:
    key: str
    order: tuple[str, ...] = ()


#: How the registry's tables are laid out.
BY_CLIENT = {
    "clients": Clustering("id"), "site_deployments": Clustering("client_id", ("deployed_at", "id")),
    "site_health_checks": Clustering("client_id", ("checked_at", "id")), "platform_inventory": Clustering("client_id", ("platform", "id")),
    "registry_operations_log": Clustering("client_id", ("started_at", "id")),
}


class ClusteredTables:
    """Tables below ``root``, known to the session as ``<prefix>_<table>``."""

    def __init__(self, spark: SparkSession, root: str, prefix: str):
        self.spark, self.root, self.prefix = spark, root.rstrip("/"), prefix
        self.folder = SharedFolder(spark, self.root)

    def write(self, tables: dict[str, DataFrame], buckets: int, layout: dict[str, Clustering] | None = None, hot_rows: int = HOT_ROWS) -> None:
        """Write all tables with the same buckets; ``buckets`` is about the input in units of a comfortable task."""
        layout = layout or BY_CLIENT
        hot = self._hot_keys({name: (frame, layout[name].key) for name, frame in tables.items()}, hot_rows)
        for name, frame in tables.items():
            key, order = layout[name].key, layout[name].order
            marked = frame.join(hot, F.col(key) == F.col("_hot"), "left")
            plain = F.col("_hot").isNotNull() | F.col(key).isNull()
            marked.where(plain).drop("_hot").write.parquet(f"{self.root}/{name}/hot")
            # Shuffled by the bucket's own hash, so every bucket is one file.
            (
                marked.where(~plain).drop("_hot").repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, *order)
                .option("path", f"{self.root}/{name}/buckets").saveAsTable(self._name(name))
            )
        described = {name: {"schema": frame.schema.jsonValue(), "key": layout[name].key, "order": layout[name].order} for name, frame in tables.items()}
        self.folder.publish("layout.json", json.dumps({"buckets": buckets, "tables": described}), replace=True)

    def _hot_keys(self, tables: dict[str, tuple[DataFrame, str]], hot_rows: int) -> DataFrame:
        """Keys with over ``hot_rows`` rows in a table: at most all rows / hot_rows."""
        hot = None
        for frame, key in tables.values():
            counted = frame.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_rows"))
            found = counted.where(F.col("_rows") > hot_rows).select("_hot")
            hot = found if hot is None else hot.unionByName(found)
        path = f"{self.root}/hot-keys"
        hot.distinct().write.parquet(path)
        known = self.spark.read.schema(hot.schema).parquet(path)
        return F.broadcast(known) if hot_rows >= SURE_ROWS else known

    def attach(self) -> None:
        """Make the written tables known to a session that did not write them."""
        described = json.loads(self.folder.read("layout.json"))
        for name, table in described["tables"].items():
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(table["schema"]))
            order = ", ".join(f"`{c}`" for c in (table["key"], *table["order"]))
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self._name(name)} ({columns}) USING parquet CLUSTERED BY (`{table['key']}`) SORTED BY ({order}) "
                f"INTO {described['buckets']} BUCKETS LOCATION '{self.root}/{name}/buckets'"
            )

    def _name(self, table: str) -> str:
        return f"{self.prefix}_{table}"

    def bucketed(self, table: str) -> DataFrame:
        return self.spark.table(self._name(table))

    def hot(self, table: str) -> DataFrame:
        return self.spark.read.schema(self.bucketed(table).schema).parquet(f"{self.root}/{table}/hot")

    def read(self, table: str) -> DataFrame:
        """All rows."""
        return self.bucketed(table).unionByName(self.hot(table))

    def per_client(self, view: Callable[[Callable[[str], DataFrame], bool], DataFrame]) -> DataFrame:
        """``view(table, co_located)`` over the buckets and over the hot clients, together."""
        return view(self.bucketed, True).unionByName(view(self.hot, False))


def clustered_inventory(tables: ClusteredTables) -> DataFrame:
    """``client_full_inventory`` over clustered tables; only hot clients are shuffled."""
    from fleetspark.plans.views import client_full_inventory

    names = ("clients", "platform_inventory", "site_deployments", "site_health_checks")
    return tables.per_client(lambda table, co_located: client_full_inventory(*[table(n) for n in names], hot_rows=None if co_located else HOT_ROWS))


def clustered_health_summary(tables: ClusteredTables, as_of) -> DataFrame:
    """``health_summary`` over clustered tables, unordered."""
    from fleetspark.plans.views import health_summary

    return tables.per_client(lambda table, co_located: health_summary(table("clients"), table("site_health_checks"), as_of, ordered=False))
