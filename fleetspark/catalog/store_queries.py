"""Registered queries over tables that they first write: versions of a table store, layouts by client.

Those of the store write the registry tables they need as version 1 and their change as the next.
"""

import uuid

from pyspark.sql import functions as F

from fleetspark.catalog.join_queries import EXPIRY_SQL
from fleetspark.catalog.lifecycle_queries import RECOVERED, SLUG_OF, _delete_requests
from fleetspark.catalog.registry import query
from fleetspark.catalog.tables import AS_OF
from fleetspark.catalog.view_queries import HEALTH_SQL, INVENTORY_SQL
from fleetspark.functions.records import json_text, json_value
from fleetspark.operators import commits, filters, joins, quality, sketches, topk
from fleetspark.plans import views
from fleetspark.session import work_dir
from fleetspark.sources import checked, ingest, layout
from fleetspark.sources.registry import conform
from fleetspark.sources.versions import VersionStore


#: Files a table in the registered queries, at least.
FILES = 8


def published(t, *names):
    store = VersionStore(t.spark, work_dir(t.spark, "store"))
    commits.publish_registry(store, {name: getattr(t, name) for name in names}, FILES)
    return store


def union(frames):
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df)
    return out


@query("commit_soft_delete", """
WITH asked AS (SELECT client_slug AS slug, min((initiated_by, trigger_source)) AS req FROM registry_operations_log WHERE operation_type = 'delete' GROUP BY 1),
c AS (SELECT clients.*, asked.req, asked.slug IS NOT NULL AND deletion_scheduled_at IS NULL AS due FROM clients LEFT JOIN asked ON asked.slug = clients.client_slug)
SELECT 1 AS version, 'clients' AS table_name, id AS key, status AS state, deletion_scheduled_at AS at FROM clients
UNION ALL SELECT 2, 'clients', id, if(due, 'deleted', status), if(due, {now}, deletion_scheduled_at) FROM c
UNION ALL SELECT 1, 'deleted_sites', original_client_id, deletion_reason, deleted_at FROM deleted_sites
UNION ALL SELECT 2, 'deleted_sites', original_client_id, deletion_reason, deleted_at FROM deleted_sites
UNION ALL SELECT 2, 'deleted_sites', id, req[2], {now} FROM c WHERE due
UNION ALL SELECT 1, 'registry_operations_log', client_id, operation_type, started_at FROM registry_operations_log
UNION ALL SELECT 2, 'registry_operations_log', client_id, operation_type, started_at FROM registry_operations_log
UNION ALL SELECT 2, 'registry_operations_log', id, 'delete', {now} FROM c WHERE due""")
def _(t):
    """Three tables change in one version; the version before stays readable."""
    store = published(t, "clients", "deleted_sites", "registry_operations_log")
    commits.commit_soft_delete(store, _delete_requests(t), AS_OF)
    shown = {
        "clients": ("id", "status", "deletion_scheduled_at"), "deleted_sites": ("original_client_id", "deletion_reason", "deleted_at"),
        "registry_operations_log": ("client_id", "operation_type", "started_at"),
    }
    return union(
        store.read(name, version).select(F.lit(version).alias("version"), F.lit(name).alias("table_name"), F.col(key).alias("key"), F.col(state).alias("state"), F.col(at).alias("at"))
        for version in store.versions() for name, (key, state, at) in shown.items()
    )


@query("commit_recover", f"""
WITH {RECOVERED}
SELECT 'clients' AS table_name, id AS key, client_slug AS slug, status AS state, created_at AS at FROM clients
UNION ALL SELECT 'clients', 'r-' || original_client_id, slug, 'active', {{now}} FROM h WHERE go
UNION ALL SELECT 'deleted_sites', original_client_id, {SLUG_OF}, if(recovered OR go, 'recovered', 'deleted'), if(go, {{now}}, recovered_at) FROM h""")
def _(t):
    store = published(t, "clients", "deleted_sites")
    asked = t.generation_requests.select(F.col("project_name").alias("client_slug")).union(t.clients.select("client_slug"))
    commits.commit_recover(store, asked.withColumn("recovered_by", F.col("client_slug")), AS_OF, F.concat(F.lit("r-"), F.col("original_client_id")))
    clients = store.read("clients").select(F.lit("clients").alias("table_name"), F.col("id").alias("key"), F.col("client_slug").alias("slug"), F.col("status").alias("state"), F.col("created_at").alias("at"))
    sites = store.read("deleted_sites").select(
        F.lit("deleted_sites").alias("table_name"), F.col("original_client_id").alias("key"), json_text(F.col("client_data"), "client_slug").alias("slug"),
        F.when(F.col("recovered"), "recovered").otherwise("deleted").alias("state"), F.col("recovered_at").alias("at"),
    )
    return clients.unionByName(sites)


@query("commit_cascade_delete", """
WITH gone AS (SELECT original_client_id AS gid FROM deleted_sites)
SELECT 'site_deployments' AS table_name, id::varchar AS id, client_id FROM site_deployments WHERE client_id NOT IN (SELECT gid FROM gone)
UNION ALL SELECT 'site_health_checks', id::varchar, client_id FROM site_health_checks WHERE client_id NOT IN (SELECT gid FROM gone)
UNION ALL SELECT 'platform_inventory', id::varchar, CASE WHEN client_id IN (SELECT gid FROM gone) THEN NULL ELSE client_id END FROM platform_inventory
UNION ALL SELECT 'registry_operations_log', id::varchar, CASE WHEN client_id IN (SELECT gid FROM gone) THEN NULL ELSE client_id END FROM registry_operations_log""")
def _(t):
    """Four tables change in one version; files without a row of a deleted client are carried over."""
    owned, linked = ["site_deployments", "site_health_checks"], ["platform_inventory", "registry_operations_log"]
    store = published(t, *owned, *linked)
    commits.commit_cascade(store, t.deleted_sites.select(F.col("original_client_id").alias("client_id")), owned, linked)
    return union(store.read(name).select(F.lit(name).alias("table_name"), "id", "client_id") for name in owned + linked)


@query("commit_delete_by_slug", """
SELECT 1 AS version, id, client_slug FROM clients
UNION ALL SELECT 2, id, client_slug FROM clients WHERE client_slug NOT IN (SELECT json_extract_string(client_data, '$.client_slug') FROM deleted_sites)""")
def _(t):
    store = published(t, "clients")
    commits.commit_delete_by_slug(store, t.deleted_sites.select(json_text(F.col("client_data"), "client_slug").alias("client_slug")))
    return union(store.read("clients", v).select(F.lit(v).alias("version"), "id", "client_slug") for v in store.versions())


@query("commit_token_changes", """
WITH used AS (SELECT id::varchar AS id, token, expires_at, used OR token IN (SELECT token FROM token_submissions) AS used FROM onboarding_tokens)
SELECT 1 AS version, id::varchar AS id, token, used FROM onboarding_tokens UNION ALL SELECT 2, id, token, used FROM used
UNION ALL SELECT 3, id, token, used FROM used WHERE expires_at >= {now}""")
def _(t):
    """Submitted tokens are marked, then expired ones go: a version each."""
    store = published(t, "onboarding_tokens")
    commits.commit_used_tokens(store, t.token_submissions)
    commits.commit_expired_tokens(store, AS_OF)
    return union(store.read("onboarding_tokens", v).select(F.lit(v).alias("version"), "id", "token", "used") for v in store.versions())


#: Buckets and the rows that make a client hot in the registered queries, whose tables are small.
BUCKETS, HOT = 8, 400


def clustered(t, *names):
    tables = layout.ClusteredTables(t.spark, work_dir(t.spark, "clustered"), f"clustered_{uuid.uuid4().hex}")
    tables.write({name: conform(getattr(t, name), name) for name in names}, BUCKETS, hot_rows=HOT)
    return tables


@query("clustered_inventory", INVENTORY_SQL)
def _(t):
    return layout.clustered_inventory(clustered(t, "clients", "platform_inventory", "site_deployments", "site_health_checks"))


@query("clustered_health_summary", HEALTH_SQL)
def _(t):
    return layout.clustered_health_summary(clustered(t, "clients", "site_health_checks"), AS_OF)


def ingested(t, name, *cluster):
    root = work_dir(t.spark, "ingested")
    ingest.write_ingested(getattr(t, name), root, name, cluster=cluster)
    return ingest.scan_ingested(t.spark, root, name)


@query("ingested_key_filter", """
SELECT id::varchar AS id, recovery_deadline, recovered, deleted_at FROM deleted_sites
WHERE json_extract_string(client_data, '$.client_slug') IN (SELECT client_slug FROM registry_operations_log WHERE operation_type = 'delete')""")
def _(t):
    asked = t.registry_operations_log.filter(F.col("operation_type") == "delete").select("client_slug")
    sites = ingested(t, "deleted_sites", "client_data__client_slug")
    return filters.json_key_filter(sites, "client_data", "client_slug", asked).select("id", "recovery_deadline", "recovered", "deleted_at")


@query("ingested_inventory", INVENTORY_SQL)
def _(t):
    return views.client_full_inventory(t.clients, ingested(t, "platform_inventory"), t.site_deployments, t.site_health_checks)


@query("ingested_backup_counts", """
SELECT id::varchar AS id, cast(json_extract_string(resource_metadata, '$.backup_count') AS bigint) AS backup_count FROM platform_inventory
WHERE cast(json_extract_string(resource_metadata, '$.backup_count') AS bigint) >= 10""")
def _(t):
    rows = ingested(t, "platform_inventory", "resource_metadata__backup_count")
    count = json_value(rows, "resource_metadata", "backup_count", "bigint")
    return rows.where(count >= 10).select("id", count.alias("backup_count"))


@query("ingested_orphans", """
SELECT id, client_slug, CASE WHEN client_slug IN (SELECT json_extract_string(client_data, '$.client_slug') FROM deleted_sites) THEN 'deleted' ELSE 'unknown' END AS origin
FROM platform_inventory WHERE is_orphaned""")
def _(t):
    orphans = t.platform_inventory.filter("is_orphaned").select("id", "client_slug")
    return joins.orphan_was_deleted(orphans, ingested(t, "deleted_sites"))


@query("ingested_backup_expiry", EXPIRY_SQL)
def _(t):
    return topk.backup_expiry(t.backups, ingested(t, "deleted_sites"), t.clients, AS_OF)


CHECKED = {
    "clients": "health_status NOT IN ('healthy', 'degraded', 'down', 'unknown')",
    "site_deployments": "status NOT IN ('in_progress', 'success', 'failed', 'canceled', 'rolled_back')",
    "deleted_sites": "recovery_deadline <= deleted_at", "site_health_checks": "overall_status NOT IN ('healthy', 'degraded', 'down', 'error')",
}
REFERRING = {"site_deployments": "client_id", "deleted_sites": "new_client_id", "site_health_checks": "client_id"}


def _broken_sql(name):
    """Table, rule and key of every broken rule of a row."""
    (rule,) = quality.CHECKS[name]
    parts = [(rule, CHECKED[name])] + [(f"not_null_{c}", f"{c} IS NULL") for c in quality.REQUIRED.get(name, [])]
    if name in REFERRING:
        parts.append((f"foreign_key_{REFERRING[name]}", f"{REFERRING[name]} IS NOT NULL AND {REFERRING[name]} NOT IN (SELECT id FROM clients)"))
    return "\nUNION ALL ".join(f"SELECT '{name}' AS table_name, '{rule}' AS rule, id::varchar AS row_key FROM {name} WHERE {broken}" for rule, broken in parts)


def _checked(t):
    root, parents = work_dir(t.spark, "checked"), {"clients": conform(t.clients, "clients")}
    return {name: checked.write_checked(getattr(t, name), root, name, {} if name == "clients" else parents) for name in CHECKED}


@query("checked_rejects", "\nUNION ALL ".join(_broken_sql(name) for name in CHECKED))
def _(t):
    return union(
        done.rejected().select(F.lit(name).alias("table_name"), F.explode(checked.RULES).alias("rule"), F.col("id").alias("row_key"))
        for name, done in _checked(t).items()
    )


@query("checked_counts", "WITH broken AS (" + "\nUNION ALL ".join(_broken_sql(name) for name in CHECKED) + ")\n" + "\nUNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS rows, count(*) - (SELECT count(DISTINCT row_key) FROM broken WHERE table_name = '{name}') AS good, "
    f"(SELECT count(*) FROM broken WHERE table_name = '{name}') AS breaks, count(*) AS stored FROM {name}" for name in CHECKED
))
def _(t):
    """Counts as observed while writing, beside the rows that were stored."""
    return union(
        done.good().select("id").unionByName(done.rejected().select("id")).agg(F.count("*").alias("stored")).select(
            F.lit(name).alias("table_name"), F.lit(done.counts["rows"]).cast("long").alias("rows"), F.lit(done.counts["good"]).cast("long").alias("good"),
            F.lit(sum(n for rule, n in done.counts.items() if rule not in ("rows", "good"))).cast("long").alias("breaks"), "stored",
        ) for name, done in _checked(t).items()
    )


@query("checked_unique", """
SELECT public_key, 1::bigint AS good, count(*) - 1 AS rejected FROM builderio_shared_spaces GROUP BY public_key""")
def _(t):
    name = "builderio_shared_spaces"
    done = checked.write_checked(t.builderio_shared_spaces, work_dir(t.spark, "checked"), name, {name: conform(t.builderio_shared_spaces.limit(0), name)})
    both = done.good().select("public_key", F.lit(1).alias("g")).unionByName(done.rejected().select("public_key", F.lit(0).alias("g")))
    return both.groupBy("public_key").agg(F.count_if(F.col("g") == 1).alias("good"), F.count_if(F.col("g") == 0).alias("rejected"))


@query("generation_metrics_sketched", """
SELECT industry, count(*) AS runs, count(*) FILTER (success) AS succeeded, count(*) FILTER (success) / count(*) AS success_rate,
 sum(generation_time_seconds)::double / count(*) AS mean_seconds, cast(sum(components_generated) AS bigint) AS components, cast(sum(files_generated) AS bigint) AS files, true AS p95_within
FROM site_generations GROUP BY industry""")
def _(t):
    """The 95th percentile out of daily sketches; its exact rank error is within the bound."""
    daily = work_dir(t.spark, "daily-metrics")
    made = sketches.daily_metrics(t.site_generations, ["industry", "project_name"])
    made.write.parquet(daily)
    rolled = sketches.rolled_up(t.spark.read.schema(made.schema).parquet(daily), ["industry"])
    errors = sketches.rank_errors(t.site_generations, rolled, ["industry"], "p95_seconds", 0.95)
    within = errors.select("industry", (F.col("rank_error") <= sketches.rank_error()).alias("p95_within"))
    return rolled.join(within, "industry").select("industry", "runs", "succeeded", "success_rate", "mean_seconds", "components", "files", "p95_within")


@query("generation_days_refreshed", """
SELECT created_at::date AS day, industry, count(*) AS runs, cast(sum(files_generated) AS bigint) AS files, count(generation_time_seconds) AS in_sketch FROM site_generations GROUP BY ALL""")
def _(t):
    """Days are stored from a part of the runs, then the days of the other runs are computed anew."""
    store, keys = VersionStore(t.spark, work_dir(t.spark, "daily-store")), ["industry"]
    early = t.site_generations.where("success")
    sketches.refresh_days(store, early, early.select(F.to_date("created_at").alias("day")), keys)
    late = t.site_generations.where("NOT success").select(F.to_date("created_at").alias("day"))
    sketches.refresh_days(store, t.site_generations, late, keys)
    return store.read("daily_metrics").select("day", "industry", "runs", "files", F.kll_sketch_get_n_double("sketch").alias("in_sketch"))
