"""Registered queries: views, lookups and lists."""

from pyspark.sql import functions as F

from fleetspark.catalog.registry import query
from fleetspark.catalog.sql_surface import register
from fleetspark.catalog.tables import AS_OF
from fleetspark.functions.records import PLATFORM_FLAGS, deletion_progress, error_count, json_text, platform_success
from fleetspark.functions.times import check_freshness, day_part, duration_ms, hour_part, moment, recovery_deadline
from fleetspark.operators import filters, joins
from fleetspark.plans import views

NEWEST_CHECK = """newest AS (
  SELECT * FROM site_health_checks QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY checked_at DESC NULLS FIRST, id) = 1)"""
LATEST_DEPLOYED = """deployed AS (
  SELECT client_id, CASE WHEN count(*) > count(deployed_at) THEN NULL ELSE max(deployed_at) END AS latest_deployment_at
  FROM site_deployments WHERE status = 'success' AND NOT rolled_back GROUP BY client_id)"""


INVENTORY_SQL = f"""
WITH {NEWEST_CHECK}, {LATEST_DEPLOYED},
gh AS (SELECT * FROM platform_inventory WHERE platform = 'github'), ve AS (SELECT * FROM platform_inventory WHERE platform = 'vercel'),
bu AS (SELECT * FROM platform_inventory WHERE platform = 'builder'), gc AS (SELECT * FROM platform_inventory WHERE platform = 'gcs')
SELECT c.id AS client_id, c.client_slug, c.client_name, c.status, c.health_status, c.last_health_check_at,
 c.builder_space_tier AS subscription_tier, c.website_type, c.contact_email, array_to_string(c.tags, '|') AS tags, c.github_repo,
 c.vercel_project_id, c.staging_url AS vercel_staging_url, c.builder_space_id,
 d.latest_deployment_at, n.overall_status AS latest_health_status, c.created_at, c.updated_at,
 gh.resource_url AS github_url, json_extract_string(gh.resource_metadata, '$.last_commit_sha') AS github_last_commit,
 ve.resource_url AS vercel_project_url, json_extract_string(ve.resource_metadata, '$.deployment_state') AS vercel_deployment_state,
 bu.resource_url AS builder_space_url, json_extract_string(bu.resource_metadata, '$.content_count') AS builder_content_count,
 json_extract_string(gc.resource_metadata, '$.latest_backup_at') AS gcs_latest_backup_at,
 json_extract_string(gc.resource_metadata, '$.backup_count') AS gcs_backup_count
FROM clients c LEFT JOIN deployed d ON d.client_id = c.id LEFT JOIN newest n ON n.client_id = c.id
LEFT JOIN gh ON gh.client_id = c.id LEFT JOIN ve ON ve.client_id = c.id LEFT JOIN bu ON bu.client_id = c.id LEFT JOIN gc ON gc.client_id = c.id
WHERE c.deletion_scheduled_at IS NULL"""


@query("client_full_inventory", INVENTORY_SQL)
def _(t):
    return views.client_full_inventory(t.clients, t.platform_inventory, t.site_deployments, t.site_health_checks)


@query("orphaned_resources", """
SELECT id, platform, resource_type, resource_name, resource_id, resource_url, discovered_at, last_verified_at, resource_metadata,
 cast(extract(DAY FROM {now} - discovered_at) AS bigint) AS orphaned_days,
 cast(extract(HOUR FROM {now} - last_verified_at) AS bigint) AS hours_since_verified
FROM platform_inventory WHERE is_orphaned AND NOT is_drift""")
def _(t):
    return views.orphaned_resources(t.platform_inventory, AS_OF)


@query("sites_pending_deletion", """
SELECT id, original_client_id, json_extract_string(client_data, '$.client_slug') AS client_slug, json_extract_string(client_data, '$.client_name') AS client_name,
 deleted_at, deleted_by, deletion_reason, recovery_deadline, cast(extract(DAY FROM recovery_deadline - {now}) AS bigint) AS days_until_permanent_deletion,
 github_deleted, vercel_deleted, builder_deleted, gcs_deleted,
 25.0::double * (github_deleted::int + vercel_deleted::int + builder_deleted::int + coalesce(gcs_deleted::int, 0)) AS deletion_progress_percent,
 recovered, recovered_at, new_client_id, permanently_deleted, permanently_deleted_at
FROM deleted_sites WHERE NOT permanently_deleted""")
def _(t):
    return views.sites_pending_deletion(t.deleted_sites, AS_OF)


@query("deployment_history", """
SELECT d.id AS deployment_id, c.client_slug, c.client_name, d.deployed_at, d.deployed_by, d.deployment_trigger, d.status, d.build_state,
 d.commit_sha, d.vercel_deployment_id, d.staging_url, d.rolled_back, cast(extract(HOUR FROM {now} - d.deployed_at) AS bigint) AS hours_ago
FROM site_deployments d JOIN clients c ON c.id = d.client_id""")
def _(t):
    return views.deployment_history(t.site_deployments, t.clients, AS_OF)


HEALTH_SQL = f"""
WITH {NEWEST_CHECK}
SELECT c.client_slug, c.client_name, c.health_status, c.last_health_check_at, n.github_status, n.vercel_status, n.builder_status,
 n.gcs_status, n.staging_url_status, cast(extract(HOUR FROM {{now}} - c.last_health_check_at) AS bigint) AS hours_since_check,
 CASE WHEN c.last_health_check_at IS NULL THEN 'never_checked' WHEN c.last_health_check_at < {{now}} - INTERVAL 24 HOUR THEN 'stale'
  WHEN c.last_health_check_at < {{now}} - INTERVAL 6 HOUR THEN 'aging' ELSE 'fresh' END AS check_freshness
FROM clients c LEFT JOIN newest n ON n.client_id = c.id WHERE c.deletion_scheduled_at IS NULL"""


@query("health_summary", HEALTH_SQL)
def _(t):
    return views.health_summary(t.clients, t.site_health_checks, AS_OF)


@query("recent_operations", """
WITH won AS (SELECT *, coalesce(json_extract_string(github_result, '$.success') = 'true', false) AS g,
  coalesce(json_extract_string(vercel_result, '$.success') = 'true', false) AS v, coalesce(json_extract_string(builder_result, '$.success') = 'true', false) AS b,
  coalesce(json_extract_string(gcs_result, '$.success') = 'true', false) AS s FROM registry_operations_log)
SELECT id AS operation_id, client_slug, operation_type, operation_status, started_at, completed_at, duration_ms, initiated_by, trigger_source,
 success_count, failure_count, if(g, 'success', 'failed') AS github_status, if(v, 'success', 'failed') AS vercel_status,
 if(b, 'success', 'failed') AS builder_status, if(s, 'success', 'failed') AS gcs_status, cast(nullif(len(error_messages), 0) AS int) AS error_count
FROM won ORDER BY started_at DESC NULLS FIRST, id LIMIT 100""")
def _(t):
    return views.recent_operations(t.registry_operations_log)


@query("recent_100", """
SELECT id, started_at, operation_type, client_slug FROM registry_operations_log ORDER BY started_at DESC NULLS FIRST, id LIMIT 100""")
def _(t):
    newest = t.registry_operations_log.orderBy(F.col("started_at").desc_nulls_first(), "id").limit(100)
    return newest.select("id", "started_at", "operation_type", "client_slug")


@query("unsafe_queries", """
SELECT id, audit_ts, operation, model, client_slug, has_client_slug_filter, url_path, space_mode
FROM builderio_query_audit WHERE security_level = 'UNSAFE'""")
def _(t):
    return views.unsafe_queries(t.builderio_query_audit)


@query("lookup_by_slug", """
SELECT client_slug, id, client_name, contact_email, website_type, builder_space_tier, status, created_at FROM clients
WHERE client_slug IN (SELECT client_slug FROM onboarding_tokens WHERE NOT used)""")
def _(t):
    columns = ["id", "client_name", "contact_email", "website_type", "builder_space_tier", "status", "created_at"]
    return filters.lookup_by_slug(t.clients, t.onboarding_tokens.filter(~F.col("used")), columns)


@query("single_row", """
SELECT tier, status, CASE WHEN count(*) = 1 THEN min(space_id) END AS space_id, CASE WHEN count(*) = 1 THEN min(space_name) END AS space_name,
 count(*) AS matches, CASE WHEN count(*) = 1 THEN 'ok' ELSE 'multiple rows' END AS reason
FROM (SELECT *, max_clients AS m FROM builderio_shared_spaces) GROUP BY tier, status, m""")
def _(t):
    keyed = filters.single_row(t.builderio_shared_spaces, ["tier", "status", "max_clients"], ["space_id", "space_name"])
    return keyed.drop("max_clients")


@query("recent_clients", "SELECT id, client_name, client_slug, contact_email, builder_space_tier, status, created_at FROM clients WHERE created_at > {now} - INTERVAL 1 HOUR")
def _(t):
    return filters.recent_clients(t.clients, AS_OF).select(
        "id", "client_name", "client_slug", "contact_email", "builder_space_tier", "status", "created_at"
    )


@query("list_sites", """
SELECT client_slug, client_name, status, health_status, github_repo FROM clients
WHERE status = 'active' AND health_status = 'healthy' ORDER BY client_slug LIMIT 50 OFFSET 10""")
def _(t):
    page = filters.list_sites(t.clients, status="active", health_status="healthy", offset=10)
    return page.select("client_slug", "client_name", "status", "health_status", "github_repo")


@query("json_key_filter", """
SELECT id, recovery_deadline, recovered, deleted_at FROM deleted_sites
WHERE json_extract_string(client_data, '$.client_slug') IN (SELECT client_slug FROM registry_operations_log WHERE operation_type = 'delete')""")
def _(t):
    asked = t.registry_operations_log.filter(F.col("operation_type") == "delete").select("client_slug")
    return filters.json_key_filter(t.deleted_sites, "client_data", "client_slug", asked).select(
        "id", "recovery_deadline", "recovered", "deleted_at"
    )


@query("inventory_by_platform", """
SELECT id, platform, resource_type, resource_id, resource_name, client_slug, is_orphaned FROM platform_inventory
WHERE platform = 'github' AND resource_type = 'repository' AND is_orphaned""")
def _(t):
    found = filters.inventory_by_platform(t.platform_inventory, "github", "repository", True)
    return found.select("id", "platform", "resource_type", "resource_id", "resource_name", "client_slug", "is_orphaned")


@query("active_tokens", """
SELECT token, client_slug, created_at, expires_at, used, round(epoch_us(expires_at) / 3.6e9 - epoch_us({now}) / 3.6e9, 6) AS hours_until_expiry
FROM onboarding_tokens WHERE NOT used AND expires_at > {now}""")
def _(t):
    live = filters.active_tokens(t.onboarding_tokens, AS_OF)
    return live.withColumn("hours_until_expiry", F.round("hours_until_expiry", 6))


@query("recoverable_sites", "SELECT id, original_client_id, deleted_at, recovery_deadline FROM deleted_sites WHERE NOT recovered")
def _(t):
    return filters.recoverable_sites(t.deleted_sites).select("id", "original_client_id", "deleted_at", "recovery_deadline")


@query("severity_order", """
SELECT client_slug, health_status, last_health_check_at, CASE health_status WHEN 'down' THEN 1 WHEN 'degraded' THEN 2 WHEN 'unknown' THEN 3 WHEN 'healthy' THEN 4 END::bigint AS severity
FROM clients""")
def _(t):
    ordered = views.by_severity(t.clients)
    return ordered.select("client_slug", "health_status", "last_health_check_at", views.severity_rank(F.col("health_status")).alias("severity"))


@query("json_text", """
SELECT id, json_extract_string(resource_metadata, '$.last_commit_sha') AS sha, json_extract_string(resource_metadata, '$.backup_count') AS backup_count,
 json_extract_string(resource_metadata, '$.latest_backup_at') AS latest_backup_at, json_extract_string(resource_metadata, '$.nothing') AS nothing FROM platform_inventory""")
def _(t):
    meta = F.col("resource_metadata")
    return t.platform_inventory.select(
        "id", json_text(meta, "last_commit_sha").alias("sha"), json_text(meta, "backup_count").alias("backup_count"),
        json_text(meta, "latest_backup_at").alias("latest_backup_at"), json_text(meta, "nothing").alias("nothing"),
    )


@query("interval_parts", """
SELECT id, cast(extract(DAY FROM {now} - checked_at) AS bigint) AS days, cast(extract(HOUR FROM {now} - checked_at) AS bigint) AS hours,
 cast(extract(DAY FROM checked_at - {now}) AS bigint) AS days_back, cast(extract(HOUR FROM checked_at - {now}) AS bigint) AS hours_back FROM site_health_checks""")
def _(t):
    now, at = moment(AS_OF), F.col("checked_at")
    return t.site_health_checks.select(
        "id", day_part(now - at).alias("days"), hour_part(now - at).alias("hours"),
        day_part(at - now).alias("days_back"), hour_part(at - now).alias("hours_back"),
    )


@query("check_freshness", """
SELECT id, CASE WHEN last_health_check_at IS NULL THEN 'never_checked' WHEN {now} - INTERVAL 24 HOUR > last_health_check_at THEN 'stale'
 WHEN {now} - INTERVAL 6 HOUR > last_health_check_at THEN 'aging' ELSE 'fresh' END AS freshness FROM clients""")
def _(t):
    return t.clients.select("id", check_freshness(F.col("last_health_check_at"), AS_OF).alias("freshness"))


@query("deletion_progress", """
SELECT id, (len(list_filter([github_deleted, vercel_deleted, builder_deleted, gcs_deleted], lambda x: x)) * 25)::double AS percent FROM deleted_sites""")
def _(t):
    return t.deleted_sites.select("id", deletion_progress(*[F.col(c) for c in PLATFORM_FLAGS]).alias("percent"))


@query("platform_success", """
SELECT id, CASE json_extract_string(github_result, '$.success') WHEN 'true' THEN 'success' ELSE 'failed' END AS github,
 CASE json_extract_string(vercel_result, '$.success') WHEN 'true' THEN 'success' ELSE 'failed' END AS vercel FROM registry_operations_log""")
def _(t):
    return t.registry_operations_log.select(
        "id", platform_success(F.col("github_result")).alias("github"), platform_success(F.col("vercel_result")).alias("vercel")
    )


@query("error_count", "SELECT id, cast(nullif(len(error_messages), 0) AS bigint) AS errors FROM registry_operations_log")
def _(t):
    return t.registry_operations_log.select("id", error_count(F.col("error_messages")).cast("bigint").alias("errors"))


@query("duration_ms", """
SELECT id, cast(round((epoch_us(completed_at) - epoch_us(coalesce(started_at, completed_at))) / 1000.0) AS bigint) AS ms
FROM registry_operations_log WHERE completed_at IS NOT NULL AND started_at IS NOT NULL
UNION ALL SELECT id, NULL FROM registry_operations_log WHERE completed_at IS NULL OR started_at IS NULL""")
def _(t):
    return t.registry_operations_log.select(
        "id", duration_ms(F.col("started_at"), F.col("completed_at")).cast("bigint").alias("ms")
    )


@query("recovery_deadline", "SELECT id, ifnull(recovery_deadline, deleted_at + INTERVAL 30 DAY) AS deadline FROM deleted_sites")
def _(t):
    return t.deleted_sites.select("id", recovery_deadline(F.col("deleted_at"), F.col("recovery_deadline")).alias("deadline"))


@query("scalar_latest_deployment", f"WITH {LATEST_DEPLOYED} SELECT * FROM deployed")
def _(t):
    return joins.latest_deployment_at(t.site_deployments)


@query("scalar_latest_health", f"WITH {NEWEST_CHECK} SELECT client_id, overall_status AS latest_health_status FROM newest")
def _(t):
    return joins.latest_health_status(t.site_health_checks)


@query("lateral_latest", f"""
WITH {NEWEST_CHECK} SELECT c.id, c.client_slug, n.overall_status, n.vercel_status FROM clients c LEFT JOIN newest n ON n.client_id = c.id""")
def _(t):
    both = joins.with_latest_health(t.clients, t.site_health_checks, ["overall_status", "vercel_status"])
    return both.select("id", "client_slug", "overall_status", "vercel_status")


@query("platform_left_joins", """
SELECT c.id, g.resource_id AS github_id, v.resource_id AS vercel_id FROM clients c
LEFT JOIN platform_inventory g ON g.client_id = c.id AND g.platform = 'github' LEFT JOIN platform_inventory v ON v.client_id = c.id AND v.platform = 'vercel'""")
def _(t):
    from fleetspark.plans.hot_keys import left_join_groups

    facts = t.platform_inventory.select(F.col("client_id").alias("_owner"), "platform", "resource_id")
    picks = {"github": [F.col("resource_id").alias("github_id")], "vercel": [F.col("resource_id").alias("vercel_id")]}
    return left_join_groups(t.clients.select("id"), "id", facts, "_owner", "platform", picks, "resource_id")


@query("deployments_clients", """
SELECT d.id, c.client_slug, c.client_name FROM clients c JOIN site_deployments d ON d.client_id = c.id""")
def _(t):
    return joins.deployments_with_clients(t.site_deployments, t.clients).select("id", "client_slug", "client_name")


SQL_TABLES = [
    "clients", "platform_inventory", "site_deployments", "site_health_checks", "deleted_sites", "registry_operations_log",
    "builderio_query_audit",
]


@query("get_latest_health_sql", f"WITH {NEWEST_CHECK} SELECT c.client_slug, n.overall_status, n.checked_at FROM clients c JOIN newest n ON n.client_id = c.id")
def _(t):
    register(t.spark, {name: getattr(t, name) for name in SQL_TABLES}, AS_OF)
    return t.spark.sql(
        "SELECT c.client_slug, h.overall_status, h.checked_at FROM clients c, LATERAL get_latest_health(c.id) h"
    )


@query("operation_history_sql", """
SELECT c.id, o.operation_type, o.operation_status, o.started_at, o.duration_ms FROM clients c JOIN registry_operations_log o ON o.client_slug = c.client_slug
QUALIFY row_number() OVER (PARTITION BY c.client_slug ORDER BY o.started_at DESC NULLS FIRST, o.id) <= 3""")
def _(t):
    register(t.spark, {name: getattr(t, name) for name in SQL_TABLES}, AS_OF)
    return t.spark.sql(
        "SELECT c.id, h.operation_type, h.operation_status, h.started_at, h.duration_ms "
        "FROM clients c, LATERAL get_client_operation_history(c.client_slug, 3) h"
    )


@query("view_counts_sql", f"""
WITH {NEWEST_CHECK}
SELECT check_freshness, overall, count(*) AS sites FROM (SELECT CASE WHEN c.last_health_check_at IS NULL THEN 'never_checked' WHEN c.last_health_check_at < {{now}} - INTERVAL 24 HOUR THEN 'stale'
  WHEN c.last_health_check_at < {{now}} - INTERVAL 6 HOUR THEN 'aging' ELSE 'fresh' END AS check_freshness, n.vercel_status AS overall
 FROM clients c LEFT JOIN newest n ON n.client_id = c.id WHERE c.deletion_scheduled_at IS NULL) GROUP BY ALL""")
def _(t):
    register(t.spark, {name: getattr(t, name) for name in SQL_TABLES}, AS_OF)
    return t.spark.sql("SELECT check_freshness, vercel_status AS overall, count(*) AS sites FROM v_health_summary GROUP BY 1, 2")
