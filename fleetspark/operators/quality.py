"""Data-quality rules of the registry schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Allowed words, unique keys, references and required columns.
CLIENT_HEALTH = ["healthy", "degraded", "down", "unknown"]
DEPLOYMENT_STATUS = ["in_progress", "success", "failed", "canceled", "rolled_back"]
CHECK_STATUS = ["healthy", "degraded", "down", "error"]
OPERATION_TYPES = ["create", "update", "delete", "recover", "health_check", "deploy", "rollback", "inventory_sync"]
OPERATION_STATUS = ["started", "in_progress", "success", "failed", "partial_success", "rolled_back"]
CHECKS = {
    "clients": {"check_health_status": lambda: F.col("health_status").isin(CLIENT_HEALTH)},
    "site_deployments": {"check_deployment_status": lambda: F.col("status").isin(DEPLOYMENT_STATUS)},
    "deleted_sites": {"check_recovery_deadline": lambda: F.col("recovery_deadline") > F.col("deleted_at")},
    "site_health_checks": {"check_overall_status": lambda: F.col("overall_status").isin(CHECK_STATUS)},
    "registry_operations_log": {
        "check_operation_type": lambda: F.col("operation_type").isin(OPERATION_TYPES),
        "check_operation_status": lambda: F.col("operation_status").isin(OPERATION_STATUS),
    },
}
UNIQUE_KEYS = [
    ("clients", ["client_slug"]),
    ("builderio_shared_spaces", ["space_id"]),
    ("builderio_shared_spaces", ["public_key"]),
    ("onboarding_tokens", ["token"]),
    ("platform_inventory", ["platform", "resource_type", "resource_id"]),
]
REFERENCES = [
    ("site_deployments", "client_id", "clients", "id"),
    ("deleted_sites", "new_client_id", "clients", "id"),
    ("site_health_checks", "client_id", "clients", "id"),
    ("platform_inventory", "client_id", "clients", "id"),
    ("registry_operations_log", "client_id", "clients", "id"),
    ("registry_operations_log", "rollback_operation_id", "registry_operations_log", "id"),
]
REQUIRED = {
    "clients": ["client_name", "client_slug", "contact_email", "website_type", "status"],
    "onboarding_tokens": ["token", "client_slug", "created_at", "expires_at", "used"],
    "site_generations": ["created_at", "project_name", "industry", "generation_time_seconds", "success"],
    "site_deployments": ["client_id", "commit_sha", "deployed_by", "status"],
    "platform_inventory": ["platform", "resource_type", "resource_id", "resource_name"],
    "registry_operations_log": ["operation_type", "operation_status", "client_slug", "initiated_by"],
}


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def check_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rule, row_key) of every row that breaks a rule; a null result passes."""
    found = []
    for name, df in tables.items():
        rules = CHECKS.get(name, {})
        if not rules:
            continue
        # One pass per table, whatever the number of its rules.
        broken = F.array_compact(F.array(*[F.when(rule() == False, key) for key, rule in rules.items()]))  # noqa: E712
        found.append(df.select(
            F.lit(name).alias("table_name"), F.explode(broken).alias("rule"), F.col("id").cast("string").alias("row_key")
        ))
    return _union(found)


def duplicate_keys(tables: dict[str, DataFrame], keys: list[tuple[str, list[str]]] = UNIQUE_KEYS) -> DataFrame:
    """(table_name, key_columns, key_value, copies) of keys that occur twice; nulls never collide."""
    found = []
    for name, columns in keys:
        if name not in tables:
            continue
        full = tables[name].dropna(subset=columns)
        twice = full.groupBy(*columns).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)
        found.append(twice.select(
            F.lit(name).alias("table_name"), F.lit(",".join(columns)).alias("key_columns"),
            F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("key_value"), "copies",
        ))
    return _union(found)


def fk_orphans(tables: dict[str, DataFrame], references=REFERENCES) -> DataFrame:
    """(table_name, column_name, row_key, missing_value) of references to no row; null passes."""
    found = []
    for name, column, parent, parent_key in references:
        if name not in tables or parent not in tables:
            continue
        child = tables[name].filter(F.col(column).isNotNull()).select("id", F.col(column).alias("_ref"))
        known = tables[parent].select(F.col(parent_key).alias("_ref"))
        found.append(child.join(known, "_ref", "left_anti").select(
            F.lit(name).alias("table_name"), F.lit(column).alias("column_name"),
            F.col("id").cast("string").alias("row_key"), F.col("_ref").cast("string").alias("missing_value"),
        ))
    return _union(found)


def not_null_report(tables: dict[str, DataFrame], only_violations: bool = False) -> DataFrame:
    """(table_name, column_name, null_count, row_count) of required columns, one pass per table."""
    found = []
    for name, df in tables.items():
        columns = REQUIRED.get(name, [])
        if not columns:
            continue
        counts = df.agg(F.count("*").alias("row_count"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        found.append(
            counts.unpivot("row_count", columns, "column_name", "null_count")
            .select(F.lit(name).alias("table_name"), "column_name", "null_count", "row_count")
        )
    report = _union(found)
    return report.filter(F.col("null_count") > 0) if only_violations else report
