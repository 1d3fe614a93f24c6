"""The registry's views.  Each takes tables and returns one DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.functions.records import (
    PLATFORM_FLAGS, deletion_progress, error_count, extracted_name, is_false, is_true, json_key, platform_success, severity_rank,
)
from fleetspark.functions.times import check_freshness, day_part, hour_part, moment
from fleetspark.operators.joins import (
    deployments_with_clients, latest_deployment_at, latest_health_status, with_latest_health,
)
from fleetspark.plans.hot_keys import HOT_ROWS, left_join_groups

PLATFORM_STATES = ["github_status", "vercel_status", "builder_status", "gcs_status", "staging_url_status"]


def client_full_inventory(
    clients: DataFrame, inventory: DataFrame, deployments: DataFrame, checks: DataFrame,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Everything known about each live client, one row per combination of its platform resources.

    The one-row-per-client parts are joined first; the parts that multiply rows
    come last, with the resources of very large clients spread over tasks.
    """
    deployed = latest_deployment_at(deployments).withColumnRenamed("client_id", "_deployed")
    health = latest_health_status(checks).withColumnRenamed("client_id", "_checked")
    live = (
        clients.filter(F.col("deletion_scheduled_at").isNull())
        .join(deployed, F.col("id") == F.col("_deployed"), "left")
        .join(health, F.col("id") == F.col("_checked"), "left")
        .select(
            F.col("id").alias("client_id"), "client_slug", "client_name", "status", "health_status",
            "last_health_check_at", F.col("builder_space_tier").alias("subscription_tier"), "website_type",
            "contact_email", "tags", "github_repo", "vercel_project_id",
            F.col("staging_url").alias("vercel_staging_url"), "builder_space_id",
            "latest_deployment_at", "latest_health_status", "created_at", "updated_at",
        )
    )
    url, meta = F.col("resource_url"), "resource_metadata"
    key = lambda name: json_key(inventory, meta, name)
    resources = {
        "github": [url.alias("github_url"), key("last_commit_sha").alias("github_last_commit")],
        "vercel": [url.alias("vercel_project_url"), key("deployment_state").alias("vercel_deployment_state")],
        "builder": [url.alias("builder_space_url"), key("content_count").alias("builder_content_count")],
        "gcs": [
            key("latest_backup_at").alias("gcs_latest_backup_at"),
            key("backup_count").alias("gcs_backup_count"),
        ],
    }
    stored = [c for c in inventory.columns if c.startswith(extracted_name(meta, ""))]
    slim = inventory.select("client_id", "platform", "resource_id", "resource_url", meta, *stored)
    return left_join_groups(
        live, "client_id", slim.withColumnRenamed("client_id", "_owner"), "_owner", "platform", resources,
        "resource_id", hot_rows,
    )


def in_order(df: DataFrame, ordered: bool, *order) -> DataFrame:
    """Sorted for output; without ``ordered`` the shuffle of a global sort is saved."""
    return df.orderBy(*order) if ordered else df


def orphaned_resources(inventory: DataFrame, as_of, ordered: bool = True) -> DataFrame:
    """Orphans that still exist on their platform, newest first."""
    now = moment(as_of)
    orphans = inventory.filter(is_true("is_orphaned") & is_false("is_drift"))
    rows = orphans.select(
        "id", "platform", "resource_type", "resource_name", "resource_id", "resource_url",
        "discovered_at", "last_verified_at", "resource_metadata",
        day_part(now - F.col("discovered_at")).alias("orphaned_days"),
        hour_part(now - F.col("last_verified_at")).alias("hours_since_verified"),
    )
    return in_order(rows, ordered, F.col("discovered_at").desc_nulls_first(), "id")


def sites_pending_deletion(deleted_sites: DataFrame, as_of, ordered: bool = True) -> DataFrame:
    """Soft-deleted sites that were not purged, by deadline."""
    waiting = deleted_sites.filter(is_false("permanently_deleted"))
    rows = waiting.select(
        "id", "original_client_id",
        json_key(waiting, "client_data", "client_slug").alias("client_slug"),
        json_key(waiting, "client_data", "client_name").alias("client_name"),
        "deleted_at", "deleted_by", "deletion_reason", "recovery_deadline",
        day_part(F.col("recovery_deadline") - moment(as_of)).alias("days_until_permanent_deletion"),
        *PLATFORM_FLAGS,
        deletion_progress(*[F.col(flag) for flag in PLATFORM_FLAGS]).alias("deletion_progress_percent"),
        "recovered", "recovered_at", "new_client_id", "permanently_deleted", "permanently_deleted_at",
    )
    return in_order(rows, ordered, F.col("recovery_deadline").asc_nulls_last(), "id")


def deployment_history(deployments: DataFrame, clients: DataFrame, as_of, ordered: bool = True) -> DataFrame:
    """Deployments with their client, newest first."""
    rows = deployments_with_clients(deployments, clients).select(
        F.col("id").alias("deployment_id"), "client_slug", "client_name", "deployed_at", "deployed_by",
        "deployment_trigger", "status", "build_state", "commit_sha", "vercel_deployment_id", "staging_url",
        "rolled_back", hour_part(moment(as_of) - F.col("deployed_at")).alias("hours_ago"),
    )
    return in_order(rows, ordered, F.col("deployed_at").desc_nulls_first(), "deployment_id")


def by_severity(df: DataFrame) -> DataFrame:
    """Worst health first, then the longest unchecked; unrated clients last."""
    return df.orderBy(
        severity_rank(F.col("health_status")).asc_nulls_last(),
        F.col("last_health_check_at").asc_nulls_first(),
        "client_slug",
    )


def health_summary(clients: DataFrame, checks: DataFrame, as_of, ordered: bool = True) -> DataFrame:
    """Live clients with the platform states of their newest check, by severity."""
    live = clients.filter(F.col("deletion_scheduled_at").isNull()).select(
        "id", "client_slug", "client_name", "health_status", "last_health_check_at"
    )
    last = F.col("last_health_check_at")
    rows = with_latest_health(live, checks, PLATFORM_STATES).select(
        "client_slug", "client_name", "health_status", "last_health_check_at", *PLATFORM_STATES,
        hour_part(moment(as_of) - last).alias("hours_since_check"),
        check_freshness(last, as_of).alias("check_freshness"),
    )
    return by_severity(rows) if ordered else rows


def recent_operations(operations: DataFrame, limit: int = 100) -> DataFrame:
    """The newest operations.  The rows are cut first, so JSON is read for those only."""
    newest = operations.orderBy(F.col("started_at").desc_nulls_first(), "id").limit(limit)
    platforms = ["github", "vercel", "builder", "gcs"]
    return newest.select(
        F.col("id").alias("operation_id"), "client_slug", "operation_type", "operation_status", "started_at",
        "completed_at", "duration_ms", "initiated_by", "trigger_source", "success_count", "failure_count",
        *[platform_success(F.col(f"{p}_result")).alias(f"{p}_status") for p in platforms],
        error_count(F.col("error_messages")).alias("error_count"),
    )


def unsafe_queries(audit: DataFrame, ordered: bool = True) -> DataFrame:
    """Content queries without a tenant filter, newest first."""
    rows = audit.filter(F.col("security_level") == "UNSAFE").select(
        "id", "audit_ts", "operation", "model", "client_slug", "has_client_slug_filter", "url_path", "space_mode"
    )
    return in_order(rows, ordered, F.col("audit_ts").desc_nulls_first(), "id")
