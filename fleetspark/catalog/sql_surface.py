"""The registry under its SQL names: tables, views and table functions of one session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetspark.plans import views

LATEST_HEALTH = """
CREATE OR REPLACE TEMPORARY FUNCTION get_latest_health(p_client_id STRING)
RETURNS TABLE (overall_status STRING, checked_at TIMESTAMP_NTZ, github_status STRING, vercel_status STRING,
               builder_status STRING, gcs_status STRING, staging_url_status STRING)
RETURN SELECT overall_status, checked_at, github_status, vercel_status, builder_status, gcs_status, staging_url_status
       FROM (SELECT c.*, row_number() OVER (PARTITION BY client_id ORDER BY checked_at DESC NULLS FIRST, id) AS place
             FROM site_health_checks c)
       WHERE place = 1 AND client_id = p_client_id
"""
# A function's parameter cannot stand in LIMIT, so rows are numbered.  The parameter is compared outside:
# inside, it would be joined first, and the rows would not be cut before the shuffle.
OPERATION_HISTORY = """
CREATE OR REPLACE TEMPORARY FUNCTION get_client_operation_history(p_client_slug STRING, p_limit INT DEFAULT 50)
RETURNS TABLE (operation_type STRING, operation_status STRING, started_at TIMESTAMP_NTZ, duration_ms INT,
               initiated_by STRING, success_count INT, failure_count INT)
RETURN SELECT operation_type, operation_status, started_at, duration_ms, initiated_by, success_count, failure_count
       FROM (SELECT o.*, row_number() OVER (PARTITION BY client_slug ORDER BY started_at DESC NULLS FIRST, id) AS place
             FROM registry_operations_log o)
       WHERE place <= p_limit AND client_slug = p_client_slug
"""


def register(spark: SparkSession, tables: dict[str, DataFrame], as_of) -> None:
    """Register tables by name, the seven views over them and the two table functions."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    t = tables
    made = {
        "v_client_full_inventory": views.client_full_inventory(
            t["clients"], t["platform_inventory"], t["site_deployments"], t["site_health_checks"]
        ),
        "v_orphaned_resources": views.orphaned_resources(t["platform_inventory"], as_of, ordered=False),
        "v_sites_pending_deletion": views.sites_pending_deletion(t["deleted_sites"], as_of, ordered=False),
        "v_deployment_history": views.deployment_history(t["site_deployments"], t["clients"], as_of, ordered=False),
        "v_health_summary": views.health_summary(t["clients"], t["site_health_checks"], as_of, ordered=False),
        "v_recent_operations": views.recent_operations(t["registry_operations_log"]),
        "unsafe_builderio_queries": views.unsafe_queries(t["builderio_query_audit"], ordered=False),
    }
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    spark.sql(LATEST_HEALTH)
    spark.sql(OPERATION_HISTORY)
