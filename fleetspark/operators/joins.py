"""Joins between registry tables and request, platform or target lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.functions.records import GATE_NOT_FOUND, derived_uuid, gate_recommendation, is_false, json_key
from fleetspark.operators.filters import single_row
from fleetspark.plans.ranking import newest_first, top_per_key


def deployments_with_clients(deployments: DataFrame, clients: DataFrame) -> DataFrame:
    """Every deployment with the slug and name of its client."""
    names = clients.select(F.col("id").alias("_client"), "client_slug", "client_name")
    return deployments.join(names, F.col("client_id") == F.col("_client"), "inner").drop("_client")


def latest_health(checks: DataFrame) -> DataFrame:
    """Newest check of each client, all columns."""
    return top_per_key(checks, ["client_id"], newest_first("checked_at", "id"))


def with_latest_health(clients: DataFrame, checks: DataFrame, columns: list[str]) -> DataFrame:
    """Clients with columns of their newest check; clients without one are kept."""
    newest = latest_health(checks.select("id", "client_id", "checked_at", *columns)).select(
        F.col("client_id").alias("_client"), *columns
    )
    return clients.join(newest, F.col("id") == F.col("_client"), "left").drop("_client")


def good_deployments(deployments: DataFrame) -> DataFrame:
    return deployments.filter((F.col("status") == "success") & is_false("rolled_back"))


def latest_deployment_at(deployments: DataFrame) -> DataFrame:
    """(client_id, latest_deployment_at) over good deployments.

    A missing time sorts as the newest, so a client with one gets null.
    """
    at = F.col("deployed_at")
    latest = F.when(F.count_if(at.isNull()) > 0, None).otherwise(F.max(at))
    return good_deployments(deployments).groupBy("client_id").agg(latest.alias("latest_deployment_at"))


def latest_health_status(checks: DataFrame) -> DataFrame:
    """(client_id, latest_health_status)."""
    slim = checks.select("id", "client_id", "checked_at", "overall_status")
    return latest_health(slim).select("client_id", F.col("overall_status").alias("latest_health_status"))


def slug_availability(candidates: DataFrame, clients: DataFrame) -> DataFrame:
    """Candidates (client_slug, ...) with ``available`` and, if taken, ``message``."""
    taken = clients.select(
        F.col("client_slug").alias("_taken"),
        F.coalesce("client_name", F.lit("Unknown")).alias("_name"),
        F.coalesce("status", F.lit("unknown")).alias("_status"),
    )
    text = F.format_string(
        "Client slug '%s' is already in use by '%s' (status: %s). Please choose a different slug.",
        F.col("client_slug"), F.col("_name"), F.col("_status"),
    )
    joined = candidates.join(taken, F.col("client_slug") == F.col("_taken"), "left")
    free = F.col("_taken").isNull()
    return joined.withColumns({"available": free, "message": F.when(~free, text)}).drop("_taken", "_name", "_status")


def unmatched_resources(inventory: DataFrame, clients: DataFrame) -> DataFrame:
    """Resources that belong to no known client; those without a client id need no join."""
    known = clients.select(F.col("id").alias("client_id"))
    stray = inventory.filter(F.col("client_id").isNotNull()).join(known, "client_id", "left_anti")
    return stray.unionByName(inventory.filter(F.col("client_id").isNull()))


def deleted_slugs(deleted_sites: DataFrame) -> DataFrame:
    """Distinct slugs of deleted sites, out of their JSON snapshots."""
    return deleted_sites.select(json_key(deleted_sites, "client_data", "client_slug").alias("client_slug")).distinct()


def orphan_was_deleted(orphans: DataFrame, deleted_sites: DataFrame) -> DataFrame:
    """Orphans with ``origin``: 'deleted' if their client once was deleted, else 'unknown'."""
    gone = deleted_slugs(deleted_sites).withColumnRenamed("client_slug", "_gone")
    joined = orphans.join(gone, F.col("client_slug") == F.col("_gone"), "left")
    return joined.withColumn("origin", F.when(F.col("_gone").isNotNull(), "deleted").otherwise("unknown")).drop("_gone")


def shared_space_for_tier(tiers: DataFrame, spaces: DataFrame) -> DataFrame:
    """The one active space of each requested tier, or null and the reason."""
    active = spaces.filter(F.col("status") == "active").select(
        "tier", F.col("id").alias("space_key"), "space_id", "space_name"
    )
    single = single_row(active, ["tier"], ["space_key", "space_id", "space_name"])
    joined = tiers.join(single, "tier", "left")
    return joined.withColumn("reason", F.coalesce("reason", F.lit("no rows")))


def rollback_links(operations: DataFrame) -> DataFrame:
    """Operations that were rolled back, with the operation that did so."""
    back = operations.select(
        F.col("id").alias("rollback_id"),
        F.col("operation_type").alias("rollback_type"),
        F.col("started_at").alias("rollback_started_at"),
    )
    undone = operations.filter(F.col("rollback_operation_id").isNotNull())
    return undone.join(back, F.col("rollback_operation_id") == F.col("rollback_id"), "left").select(
        F.col("id").alias("operation_id"), "operation_type", "client_slug",
        "rollback_operation_id", "rollback_type", "rollback_started_at",
    )


def client_fallback(requests: DataFrame, clients: DataFrame, new_id=None) -> DataFrame:
    """Requests with client id and contact from the registry, else from the request.

    ``new_id`` makes the id of an unknown client; by default a UUID made from its slug.
    """
    known = clients.select(
        F.col("client_slug").alias("_slug"), F.col("id").alias("_id"), F.col("contact_email").alias("_email")
    )
    joined = requests.join(known, F.col("project_name") == F.col("_slug"), "left")
    fresh = derived_uuid(F.lit("client"), F.col("project_name")) if new_id is None else new_id
    email = F.coalesce("_email", F.when(F.col("_slug").isNull(), F.coalesce("contact_email", F.lit("unknown@example.com"))))
    return joined.withColumns({"client_id": F.coalesce("_id", fresh), "contact_email": email}).drop("_slug", "_id", "_email")


def generation_gate(requests: DataFrame, clients: DataFrame) -> DataFrame:
    """Requests with ``allowed``, ``reason`` and ``recommendation``: only active clients pass."""
    known = clients.select(F.col("client_slug").alias("_slug"), F.col("status").alias("client_status"))
    joined = requests.join(known, F.col("project_name") == F.col("_slug"), "left")
    unknown, status = F.col("_slug").isNull(), F.col("client_status")
    active = ~unknown & status.eqNullSafe("active")
    return joined.withColumns({
        "allowed": active,
        "reason": F.when(unknown, "Client not found").when(~active, "Client not ready for site generation"),
        "recommendation": F.when(unknown, GATE_NOT_FOUND).when(~active, gate_recommendation(status)),
    }).drop("_slug")


def inventory_reconcile(observed: DataFrame, registered: DataFrame, as_of) -> DataFrame:
    """Platform listing against registry: matched, orphaned (platform only), drift (registry only)."""
    key = ["platform", "resource_type", "resource_id"]
    seen = observed.select(*key, F.col("resource_name").alias("observed_name"), F.lit(True).alias("_seen"))
    kept = registered.select(
        *key, F.col("resource_name").alias("registered_name"), "client_id", "last_verified_at", F.lit(True).alias("_kept")
    )
    state = (
        F.when(F.col("_seen") & F.col("_kept"), "matched").when(F.col("_seen"), "orphaned").otherwise("drift")
    )
    return (
        seen.join(kept, key, "full_outer")
        .withColumn("state", state)
        .select(
            *key,
            F.coalesce("observed_name", "registered_name").alias("resource_name"),
            "client_id",
            "state",
            (F.col("state") == "orphaned").alias("is_orphaned"),
            (F.col("state") == "drift").alias("is_drift"),
            F.when(F.col("_seen"), as_of).otherwise(F.col("last_verified_at")).alias("last_verified_at"),
        )
    )


def env_diff(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """Action per desired variable: skip (null value), update (with the first existing id) or create."""
    first = existing.groupBy("project", "key").agg(F.min("id").alias("existing_id"))
    joined = desired.join(first, ["project", "key"], "left")
    action = F.when(F.col("value").isNull(), "skip").when(F.col("existing_id").isNotNull(), "update").otherwise("create")
    return joined.withColumn("action", action).withColumn(
        "existing_id", F.when(F.col("action") == "update", F.col("existing_id"))
    )
