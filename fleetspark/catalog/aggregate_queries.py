"""Registered queries: aggregations and data quality."""

from pyspark.sql import functions as F

from fleetspark.catalog.registry import query
from fleetspark.catalog.tables import AS_OF
from fleetspark.operators import aggregates, quality



@query("token_status_counts", """
SELECT CASE WHEN used THEN 'used' WHEN expires_at < {now} THEN 'expired' ELSE 'active' END AS status, count(*) AS count FROM onboarding_tokens GROUP BY 1""")
def _(t):
    return aggregates.token_status_counts(t.onboarding_tokens, AS_OF)


@query("listing_counts", """
SELECT 'backups' AS listing, client_slug AS owner, count(*) AS count FROM backups GROUP BY ALL
UNION ALL SELECT platform, client_slug, count(*) FROM platform_inventory WHERE platform IN ('github', 'vercel') GROUP BY ALL""")
def _(t):
    out = aggregates.listing_counts(t.backups, "client_slug").select(F.lit("backups").alias("listing"), F.col("client_slug").alias("owner"), "count")
    for platform in ("github", "vercel"):
        listing = t.platform_inventory.filter(F.col("platform") == platform)
        counts = aggregates.listing_counts(listing, "client_slug")
        out = out.unionByName(counts.select(F.lit(platform).alias("listing"), F.col("client_slug").alias("owner"), "count"))
    return out


@query("operation_rollup", """
WITH r AS (SELECT id, unnest([github_result, vercel_result, builder_result, gcs_result, supabase_result]) AS doc FROM registry_operations_log),
c AS (SELECT id, count(*) FILTER (json_extract_string(doc, '$.success') = 'true') AS won, count(doc) AS given FROM r GROUP BY id)
SELECT id, won AS success_count, given - won AS failure_count,
 CASE WHEN given = 0 THEN 'in_progress' WHEN won = given THEN 'success' WHEN won = 0 THEN 'failed' ELSE 'partial_success' END AS operation_status FROM c""")
def _(t):
    rolled = aggregates.operation_rollup(t.registry_operations_log)
    whole = lambda c: F.col(c).cast("bigint").alias(c)
    return rolled.select("id", whole("success_count"), whole("failure_count"), "operation_status")


@query("space_usage", """
WITH u AS (SELECT builder_shared_space_id AS sid, count(*) FILTER (status = 'active') AS n FROM clients WHERE builder_shared_space_id IS NOT NULL GROUP BY 1)
SELECT s.id, s.space_name, s.tier, s.max_clients, s.active_clients, coalesce(n, 0) AS used_clients,
 CASE WHEN coalesce(n, 0) >= s.max_clients THEN 'full' ELSE s.status END AS usage_status FROM builderio_shared_spaces s LEFT JOIN u ON u.sid = s.id""")
def _(t):
    return aggregates.space_usage(t.clients, t.builderio_shared_spaces)


@query("overall_health", """
SELECT id, CASE WHEN vercel_status = 'down' OR staging_url_status = 'down' THEN 'down'
 WHEN github_status = 'healthy' AND vercel_status = 'healthy' AND builder_status = 'healthy' AND gcs_status = 'healthy' AND staging_url_status = 'healthy' THEN 'healthy'
 WHEN coalesce(github_status, vercel_status, builder_status, gcs_status, staging_url_status) IS NULL THEN 'error' ELSE 'degraded' END AS derived_status FROM site_health_checks""")
def _(t):
    return aggregates.with_overall_health(t.site_health_checks).select("id", "derived_status")


@query("generation_metrics", """
SELECT industry, project_name, count(*) AS runs, count(*) FILTER (success) AS succeeded, count(*) FILTER (success) / count(*) AS success_rate,
 sum(generation_time_seconds)::double / count(*) AS mean_seconds, cast(sum(components_generated) AS bigint) AS components, cast(sum(files_generated) AS bigint) AS files,
 round(quantile_cont(generation_time_seconds::double, 0.95), 5) AS p95_seconds FROM site_generations GROUP BY industry, project_name""")
def _(t):
    m = aggregates.generation_metrics(t.site_generations, ["industry", "project_name"])
    return _rounded(m)


@query("generation_metrics_by_industry", """
SELECT industry, count(*) AS runs, count(*) FILTER (success) AS succeeded, count(*) FILTER (success) / count(*) AS success_rate,
 sum(generation_time_seconds)::double / count(*) AS mean_seconds, cast(sum(components_generated) AS bigint) AS components, cast(sum(files_generated) AS bigint) AS files,
 round(quantile_cont(generation_time_seconds::double, 0.95), 5) AS p95_seconds FROM site_generations GROUP BY industry""")
def _(t):
    return _rounded(aggregates.generation_metrics(t.site_generations, ["industry"]))


def _rounded(m):
    return m.withColumn("p95_seconds", F.round("p95_seconds", 5))


@query("health_trend", "SELECT client_id, date_trunc('day', checked_at)::timestamp AS bucket, overall_status, count(*) AS checks FROM site_health_checks GROUP BY ALL")
def _(t):
    return aggregates.health_trend(t.site_health_checks)


@query("build_log_tail", """
WITH e AS (SELECT deployment_id, text, row_number() OVER (PARTITION BY deployment_id ORDER BY created_at DESC, event_id DESC) AS n FROM build_events WHERE type IN ('stderr', 'error') AND text <> ''),
l AS (SELECT deployment_id, string_agg(text, chr(10) ORDER BY n DESC) AS logs FROM e WHERE n <= 10 GROUP BY 1)
SELECT d.id AS deployment_id, coalesce(l.logs, 'Build failed but no error logs available') AS build_logs FROM site_deployments d LEFT JOIN l ON l.deployment_id = d.id""")
def _(t):
    return aggregates.build_log_tail(t.site_deployments.select(F.col("id").alias("deployment_id")), t.build_events)


@query("check_violations", """
SELECT 'clients' AS table_name, 'check_health_status' AS rule, id::varchar AS row_key FROM clients WHERE health_status NOT IN ('healthy', 'degraded', 'down', 'unknown')
UNION ALL SELECT 'site_deployments', 'check_deployment_status', id::varchar FROM site_deployments WHERE status NOT IN ('in_progress', 'success', 'failed', 'canceled', 'rolled_back')
UNION ALL SELECT 'deleted_sites', 'check_recovery_deadline', id::varchar FROM deleted_sites WHERE recovery_deadline <= deleted_at
UNION ALL SELECT 'site_health_checks', 'check_overall_status', id::varchar FROM site_health_checks WHERE overall_status NOT IN ('healthy', 'degraded', 'down', 'error')
UNION ALL SELECT 'registry_operations_log', 'check_operation_type', id::varchar FROM registry_operations_log WHERE operation_type NOT IN ('create', 'update', 'delete', 'recover', 'health_check', 'deploy', 'rollback', 'inventory_sync')
UNION ALL SELECT 'registry_operations_log', 'check_operation_status', id::varchar FROM registry_operations_log WHERE operation_status NOT IN ('started', 'in_progress', 'success', 'failed', 'partial_success', 'rolled_back')""")
def _(t):
    return quality.check_violations({name: getattr(t, name) for name in quality.CHECKS})


@query("duplicate_keys", """
SELECT 'clients' AS table_name, 'client_slug' AS key_columns, client_slug AS key_value, count(*) AS copies FROM clients WHERE client_slug IS NOT NULL GROUP BY client_slug HAVING count(*) > 1
UNION ALL SELECT 'builderio_shared_spaces', 'space_id', space_id, count(*) FROM builderio_shared_spaces WHERE space_id IS NOT NULL GROUP BY space_id HAVING count(*) > 1
UNION ALL SELECT 'builderio_shared_spaces', 'public_key', public_key, count(*) FROM builderio_shared_spaces WHERE public_key IS NOT NULL GROUP BY public_key HAVING count(*) > 1
UNION ALL SELECT 'onboarding_tokens', 'token', token, count(*) FROM onboarding_tokens WHERE token IS NOT NULL GROUP BY token HAVING count(*) > 1
UNION ALL SELECT 'platform_inventory', 'platform,resource_type,resource_id', concat_ws('|', platform, resource_type, resource_id), count(*) FROM platform_inventory
 GROUP BY platform, resource_type, resource_id HAVING count(*) > 1""")
def _(t):
    return quality.duplicate_keys({name: getattr(t, name) for name, _ in quality.UNIQUE_KEYS})


@query("fk_orphans", """
WITH refs AS (SELECT 'site_deployments' AS table_name, 'client_id' AS column_name, id::varchar AS row_key, client_id AS missing_value FROM site_deployments
UNION ALL SELECT 'deleted_sites', 'new_client_id', id::varchar, new_client_id FROM deleted_sites
UNION ALL SELECT 'site_health_checks', 'client_id', id::varchar, client_id FROM site_health_checks
UNION ALL SELECT 'platform_inventory', 'client_id', id::varchar, client_id FROM platform_inventory
UNION ALL SELECT 'registry_operations_log', 'client_id', id::varchar, client_id FROM registry_operations_log)
SELECT * FROM refs WHERE missing_value IS NOT NULL AND missing_value NOT IN (SELECT id FROM clients)
UNION ALL SELECT 'registry_operations_log', 'rollback_operation_id', id::varchar, rollback_operation_id::varchar FROM registry_operations_log
 WHERE rollback_operation_id IS NOT NULL AND rollback_operation_id NOT IN (SELECT id FROM registry_operations_log)""")
def _(t):
    names = {r[0] for r in quality.REFERENCES} | {"clients"}
    return quality.fk_orphans({name: getattr(t, name) for name in names})


@query("not_null_report", "\nUNION ALL ".join(
    f"SELECT '{table}' AS table_name, '{column}' AS column_name, count(*) FILTER ({column} IS NULL) AS null_count, count(*) AS row_count FROM {table}"
    for table, columns in quality.REQUIRED.items() for column in columns
))
def _(t):
    return quality.not_null_report({name: getattr(t, name) for name in quality.REQUIRED})
