"""Newest rows per key, pages and retention plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.functions.records import is_false, json_key
from fleetspark.functions.times import moment, recovery_deadline
from fleetspark.operators.joins import good_deployments, latest_health
from fleetspark.plans.ranking import newest_first, nth_per_key, top_per_key

# Content models to archive and entries read per model.
ARCHIVE_MODELS = ["page", "section", "blog-post", "product", "symbol"]
ARCHIVE_LIMIT = 100
ARCHIVE_KEYS = ["__archived_at", "__archived_for_deletion"]
HEALTH_COLUMNS = [
    "overall_status", "checked_at", "github_status", "vercel_status", "builder_status", "gcs_status",
    "staging_url_status",
]
OPERATION_COLUMNS = [
    "operation_type", "operation_status", "started_at", "duration_ms", "initiated_by", "success_count", "failure_count",
]


def get_latest_health(checks: DataFrame, client_id: str | None = None) -> DataFrame:
    """Newest check per client, or of one client."""
    rows = checks if client_id is None else checks.filter(F.col("client_id") == client_id)
    return latest_health(rows.select("id", "client_id", *HEALTH_COLUMNS)).select("client_id", *HEALTH_COLUMNS)


def operation_history(operations: DataFrame, client_slug: str | None = None, limit: int = 50) -> DataFrame:
    """Newest operations per client, or of one client."""
    rows = operations if client_slug is None else operations.filter(F.col("client_slug") == client_slug)
    slim = rows.select("id", "client_slug", *OPERATION_COLUMNS)
    return top_per_key(slim, ["client_slug"], newest_first("started_at", "id"), limit).select(
        "id", "client_slug", *OPERATION_COLUMNS
    )


def latest_success(deployments: DataFrame) -> DataFrame:
    return top_per_key(good_deployments(deployments), ["client_id"], newest_first("deployed_at", "id"))


def rollback_target(deployments: DataFrame) -> DataFrame:
    """Version before the current one: the second newest good deployment per client."""
    good = good_deployments(deployments).select("id", "client_id", "commit_sha", "deployed_at")
    return nth_per_key(good, ["client_id"], newest_first("deployed_at", "id"), 2)


def newest_backup_first():
    """Order of a backup listing: newest first, an unknown time last."""
    return [F.col("created_at").desc_nulls_last(), F.col("name").asc()]


def list_backups(backups: DataFrame, client_slug: str | None = None, ordered: bool = True) -> DataFrame:
    rows = backups if client_slug is None else backups.filter(F.col("client_slug") == client_slug)
    return rows.orderBy("client_slug", *newest_backup_first()) if ordered else rows


def latest_backup(clients: DataFrame, backups: DataFrame) -> DataFrame:
    """Newest backup per client, or an error text for a client without one."""
    newest = top_per_key(backups, ["client_slug"], newest_backup_first()).select(
        F.col("client_slug").alias("_slug"), F.col("name").alias("backup_name"), "size_bytes",
        F.col("created_at").alias("backup_created_at"),
    )
    joined = clients.select("client_slug").join(newest, F.col("client_slug") == F.col("_slug"), "left")
    missing = F.when(F.col("_slug").isNull(), F.concat(F.lit("No backups found for "), F.col("client_slug")))
    return joined.withColumn("error", missing).drop("_slug")


def with_keep_flag(backups: DataFrame, keep_latest: bool = True) -> DataFrame:
    """Every backup with ``keep``: true for the newest of its client if it is to stay.

    The newest per client is found first and joined back, so the listing of a
    client with very many backups is never sorted in one task.
    """
    if not keep_latest:
        return backups.withColumn("keep", F.lit(False))
    newest = top_per_key(backups, ["client_slug"], newest_backup_first()).select(
        F.col("client_slug").alias("_slug"), F.col("name").alias("_kept")
    )
    joined = backups.join(newest, F.col("client_slug") == F.col("_slug"), "left")
    return joined.withColumn("keep", F.col("name") == F.col("_kept")).drop("_slug", "_kept")


def backup_retention(backups: DataFrame, keep_latest: bool = True) -> DataFrame:
    """Deletion plan, one row per backup to delete."""
    return with_keep_flag(backups, keep_latest).filter(~F.col("keep")).drop("keep")


def backup_retention_summary(backups: DataFrame, keep_latest: bool = True) -> DataFrame:
    """Per client: backups to delete, bytes freed and the one kept."""
    keep = F.col("keep")
    return with_keep_flag(backups, keep_latest).groupBy("client_slug").agg(
        F.count_if(~keep).alias("deleted_count"),
        F.sum(F.when(~keep, F.col("size_bytes"))).alias("freed_bytes"),
        F.max(F.when(keep, F.col("name"))).alias("kept_backup"),
    )


def backup_expiry(backups: DataFrame, deleted_sites: DataFrame, clients: DataFrame, as_of) -> DataFrame:
    """Backups of soft-deleted, unrecovered sites past their deadline; a slug that a live client has keeps all of its."""
    deadline = recovery_deadline(F.col("deleted_at"), F.col("recovery_deadline"))
    expired = (
        deleted_sites.filter(is_false("recovered") & (deadline < moment(as_of)))
        .groupBy(json_key(deleted_sites, "client_data", "client_slug").alias("client_slug"))
        .agg(F.max(deadline).alias("deadline"))
    )
    live = clients.filter(~F.col("status").eqNullSafe("deleted")).select("client_slug")
    return backups.join(expired.join(live, "client_slug", "left_anti"), "client_slug", "inner")


def archive_batch(entries: DataFrame, archived_at, limit: int = ARCHIVE_LIMIT) -> DataFrame:
    """First entries of each space and archivable model, with two archive keys set in their JSON."""
    rows = entries.filter(F.col("model").isin(ARCHIVE_MODELS))
    first = top_per_key(rows, ["space_id", "model"], [F.col("id").asc_nulls_last()], limit).filter(F.col("id").isNotNull())
    return first.withColumn("data", stamped_json(F.col("data"), archived_at))


def stamped_json(data, archived_at):
    """JSON object text with the two archive keys replaced or added.

    As a VARIANT each value keeps its type, nested ones included.
    """
    when = F.date_format(moment(archived_at), "yyyy-MM-dd'T'HH:mm:ss")
    old = F.coalesce(F.try_parse_json(data).cast("map<string, variant>"), F.create_map().cast("map<string, variant>"))
    kept = F.map_filter(old, lambda key, _: ~key.isin(*ARCHIVE_KEYS))
    stamp = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ARCHIVE_KEYS]), F.array(when.cast("variant"), F.lit(True).cast("variant"))
    )
    return F.to_json(F.map_concat(kept, stamp))


def archive_counts(batch: DataFrame) -> DataFrame:
    return batch.groupBy("space_id", "model").agg(F.count("*").alias("archived_count"))
