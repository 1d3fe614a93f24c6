"""All records of a site, in one long table or nested."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.plans.ranking import newest_first, top_per_key

COLUMNS = ["client_slug", "kind", "at", "id", "label", "status"]


def site_details(clients: DataFrame, deployments: DataFrame, checks: DataFrame, operations: DataFrame) -> DataFrame:
    """(client_slug, kind, at, id, label, status): each client and every one of its deployments, checks and operations.

    A long table needs no array per client, so a client may have any number of rows.
    """
    owner = clients.select(F.col("id").alias("_client"), "client_slug")
    site = clients.select(
        "client_slug", F.lit("site").alias("kind"), F.col("created_at").alias("at"), F.col("id").cast("string").alias("id"),
        F.col("client_name").alias("label"), "status",
    )
    by_client = [
        ("deployment", deployments, "deployed_at", F.col("commit_sha"), F.col("status")),
        ("health_check", checks, "checked_at", F.lit(None).cast("string"), F.col("overall_status")),
    ]
    out = site
    for kind, df, at, label, status in by_client:
        rows = df.select("client_id", F.lit(kind).alias("kind"), F.col(at).alias("at"), F.col("id").cast("string").alias("id"), label.alias("label"), status.alias("status"))
        out = out.unionByName(rows.join(owner, F.col("client_id") == F.col("_client")).select(*COLUMNS))
    slugs = clients.select(F.col("client_slug").alias("_slug"))
    rows = operations.select(
        "client_slug", F.lit("operation").alias("kind"), F.col("started_at").alias("at"), F.col("id").cast("string").alias("id"),
        F.col("operation_type").alias("label"), F.col("operation_status").alias("status"),
    )
    return out.unionByName(rows.join(slugs, F.col("client_slug") == F.col("_slug"), "left_semi"))


def _nested(df: DataFrame, key: str, at: str, columns: list[str], name: str, n: int) -> DataFrame:
    """(key, name): the newest n rows per key as an array, newest first."""
    slim = df.select(key, at, "id", *[c for c in columns if c not in (at, "id", key)])
    top = top_per_key(slim, [key], newest_first(at, "id"), n, rank="_n")
    packed = F.sort_array(F.collect_list(F.struct("_n", F.struct(*columns).alias("row"))))
    return top.groupBy(F.col(key).alias(f"_{name}")).agg(F.transform(packed, lambda x: x["row"]).alias(name))


def site_summary(clients: DataFrame, deployments: DataFrame, checks: DataFrame, operations: DataFrame, n: int) -> DataFrame:
    """One row per client with its newest n records of each kind as arrays, empty where there are none."""
    children = [
        ("id", _nested(deployments, "client_id", "deployed_at", ["deployed_at", "commit_sha", "status"], "deployments", n)),
        ("id", _nested(checks, "client_id", "checked_at", ["checked_at", "overall_status"], "health_history", n)),
        ("client_slug", _nested(operations, "client_slug", "started_at", ["started_at", "operation_type", "operation_status"], "operations", n)),
    ]
    out = clients
    for key, child in children:
        child_key, name = child.columns
        out = out.join(child, F.col(key) == F.col(child_key), "left").drop(child_key)
        out = out.withColumn(name, F.coalesce(name, F.array().cast(child.schema[name].dataType)))
    return out
