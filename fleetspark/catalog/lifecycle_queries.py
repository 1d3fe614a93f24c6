"""Registered queries: row changes, sources and sinks."""

import re

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from fleetspark.catalog.registry import query
from fleetspark.catalog.tables import AS_OF
from fleetspark.functions.records import json_text
from fleetspark.functions.responses import parse_response_files
from fleetspark.functions.times import duration_ms, moment
from fleetspark.operators import lifecycle, topk
from fleetspark.fixtures import TABLE_SQL
from fleetspark.schemas import TABLES
from fleetspark.session import work_dir
from fleetspark.sources import messages, registry, snapshots, writers

SLUG_OF = "json_extract_string(client_data, '$.client_slug')"
DEADLINE = "coalesce(recovery_deadline, deleted_at + INTERVAL 30 DAY)"


@query("mark_orphaned", """
SELECT id, client_id, CASE WHEN client_id IS NULL THEN true ELSE is_orphaned END AS is_orphaned FROM platform_inventory""")
def _(t):
    return lifecycle.mark_orphaned(t.platform_inventory).select("id", "client_id", "is_orphaned")


@query("mark_orphaned_count", "SELECT count(*) AS updated FROM platform_inventory WHERE client_id IS NULL AND NOT is_orphaned")
def _(t):
    # The count is observed while the changed table is written.
    observation = Observation()
    lifecycle.mark_orphaned(t.platform_inventory, observation).write.parquet(work_dir(t.spark, "orphans"))
    return t.spark.createDataFrame([(observation.get["updated"],)], "updated bigint")


@query("sync_inventory", """
WITH s AS (SELECT DISTINCT project_name AS slug FROM generation_requests)
SELECT p.id, p.client_slug, CASE WHEN s.slug IS NULL THEN p.client_id ELSE c.id END AS client_id, s.slug IS NULL AND p.is_orphaned AS is_orphaned,
 CASE WHEN s.slug IS NULL THEN p.last_verified_at ELSE {now} END AS last_verified_at
FROM platform_inventory p LEFT JOIN s ON s.slug = p.client_slug LEFT JOIN clients c ON c.client_slug = s.slug""")
def _(t):
    slugs = t.generation_requests.select(F.col("project_name").alias("client_slug"))
    return lifecycle.sync_inventory(t.platform_inventory, t.clients, slugs, AS_OF).select(
        "id", "client_slug", "client_id", "is_orphaned", "last_verified_at"
    )


@query("apply_space_deltas", """
WITH d AS (SELECT space_id, list(delta ORDER BY requested_at, id) AS deltas FROM space_deltas GROUP BY space_id)
SELECT s.id, s.space_name, CASE WHEN d.space_id IS NULL THEN s.active_clients ELSE list_reduce(d.deltas, lambda n, x: greatest(0, n + x), s.active_clients) END AS active_clients,
 CASE WHEN d.space_id IS NULL THEN s.updated_at ELSE {now} END AS updated_at
FROM builderio_shared_spaces s LEFT JOIN d ON d.space_id = s.id""")
def _(t):
    return lifecycle.apply_space_deltas(t.builderio_shared_spaces, t.space_deltas, AS_OF).select("id", "space_name", "active_clients", "updated_at")


@query("expire_tokens", "SELECT id, token, client_slug, expires_at, used FROM onboarding_tokens WHERE expires_at >= {now}")
def _(t):
    return lifecycle.expire_tokens(t.onboarding_tokens, AS_OF).select("id", "token", "client_slug", "expires_at", "used")


@query("consume_tokens", "SELECT id, token, used OR token IN (SELECT token FROM token_submissions) AS used FROM onboarding_tokens")
def _(t):
    return lifecycle.consume_tokens(t.onboarding_tokens, t.token_submissions).select("id", "token", "used")


def _delete_requests(t):
    log = t.registry_operations_log.filter(F.col("operation_type") == "delete")
    return log.select("client_slug", F.col("initiated_by").alias("deleted_by"), F.col("trigger_source").alias("reason"))


@query("soft_delete", """
WITH asked AS (SELECT client_slug AS slug, min((initiated_by, trigger_source)) AS req FROM registry_operations_log WHERE operation_type = 'delete' GROUP BY 1)
SELECT c.id, CASE WHEN due THEN 'deleted' ELSE c.status END AS status, CASE WHEN due THEN {now} ELSE c.deletion_scheduled_at END AS deletion_scheduled_at,
 CASE WHEN due THEN c.client_slug END AS snapshot_slug, CASE WHEN due THEN {now} + INTERVAL 30 DAY END AS recovery_deadline,
 CASE WHEN due THEN req[1] END AS deleted_by, CASE WHEN due THEN req[2] END AS deletion_reason, CASE WHEN due THEN 'delete' END AS logged
FROM (SELECT clients.*, asked.req, asked.slug IS NOT NULL AND deletion_scheduled_at IS NULL AS due FROM clients LEFT JOIN asked ON asked.slug = clients.client_slug) c""")
def _(t):
    clients, deleted, log = lifecycle.soft_delete(t.clients, _delete_requests(t), AS_OF)
    gone = deleted.select(
        F.col("original_client_id").alias("id"), json_text(F.col("client_data"), "client_slug").alias("snapshot_slug"),
        "recovery_deadline", "deleted_by", "deletion_reason",
    )
    logged = log.select(F.col("client_id").alias("id"), F.col("operation_type").alias("logged"))
    return clients.select("id", "status", "deletion_scheduled_at").join(gone, "id", "left").join(logged, "id", "left")


@query("recover_eligibility", f"""
SELECT id, original_client_id, NOT recovered AND NOT permanently_deleted AND {DEADLINE} > {{now}} AS eligible,
 CASE WHEN recovered THEN 'already recovered' WHEN permanently_deleted THEN 'permanently deleted' WHEN {DEADLINE} <= {{now}} THEN 'recovery window closed' END AS reason FROM deleted_sites""")
def _(t):
    return lifecycle.recovery_eligibility(t.deleted_sites, AS_OF).select("id", "original_client_id", "eligible", "reason")


# Asked for, eligible, newest of its slug, and the slug free.
RECOVERED = f"""asked AS (SELECT DISTINCT project_name AS slug FROM generation_requests UNION SELECT client_slug FROM clients),
d AS (SELECT *, {SLUG_OF} AS slug, NOT recovered AND NOT permanently_deleted AND {DEADLINE} > {{now}} AS fit FROM deleted_sites),
r AS (SELECT id, row_number() OVER (PARTITION BY slug ORDER BY deleted_at DESC, id) AS place FROM d WHERE fit),
g AS (SELECT d.*, d.slug IN (SELECT slug FROM asked) AS wanted, d.slug IN (SELECT client_slug FROM clients WHERE status <> 'deleted') AS taken, r.place FROM d LEFT JOIN r ON r.id = d.id),
h AS (SELECT *, wanted AND fit AND NOT taken AND place = 1 AS go FROM g)"""


def _recovered(t):
    asked = t.generation_requests.select(F.col("project_name").alias("client_slug")).union(t.clients.select("client_slug"))
    requests = asked.withColumn("recovered_by", F.col("client_slug"))
    return lifecycle.recover(t.deleted_sites, requests, t.clients, AS_OF, F.concat(F.lit("r-"), F.col("original_client_id")))


@query("recover", f"""
WITH {RECOVERED}
SELECT 'r-' || original_client_id AS id, slug AS client_slug, json_extract_string(client_data, '$.client_name') AS client_name, 'premium' AS builder_space_tier, 'DEDICATED' AS builder_space_mode,
 json_extract_string(client_data, '$.industry') AS industry, json_extract_string(client_data, '$.github_repo') AS github_repo, 'vip' AS tags, original_client_id, 'active' AS status,
 {{now}} AS created_at, NULL::timestamp AS deletion_scheduled_at FROM h WHERE go""")
def _(t):
    return _recovered(t)[0].select(
        "id", "client_slug", "client_name", "builder_space_tier", "builder_space_mode", "industry", "github_repo", "tags", "original_client_id", "status",
        "created_at", "deletion_scheduled_at",
    )


@query("recover_marks", f"""
WITH {RECOVERED}
SELECT id, recovered OR go AS recovered, CASE WHEN go THEN {{now}} ELSE recovered_at END AS recovered_at, CASE WHEN go THEN 'r-' || original_client_id ELSE new_client_id END AS new_client_id,
 CASE WHEN NOT wanted OR go THEN NULL WHEN recovered THEN 'already recovered' WHEN permanently_deleted THEN 'permanently deleted' WHEN NOT fit THEN 'recovery window closed'
  WHEN taken THEN 'slug in use' ELSE 'newer deletion recovered' END AS recovery_error FROM h""")
def _(t):
    return _recovered(t)[1].select("id", "recovered", "recovered_at", "new_client_id", "recovery_error")


@query("purge_due", f"""
SELECT id, original_client_id, {DEADLINE} AS deadline, CASE WHEN {DEADLINE} < {{now}} THEN 'due' WHEN {DEADLINE} - {{now}} <= INTERVAL 1 DAY THEN 'warn_1_day'
 WHEN {DEADLINE} - {{now}} <= INTERVAL 7 DAY THEN 'warn_7_days' ELSE 'waiting' END AS stage FROM deleted_sites WHERE NOT recovered AND NOT permanently_deleted""")
def _(t):
    return lifecycle.purge_due(t.deleted_sites, AS_OF)


@query("touch_updated_at", """
WITH n AS (SELECT client_id, overall_status, checked_at FROM site_health_checks QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY checked_at DESC NULLS FIRST, id) = 1)
SELECT c.id, CASE WHEN n.overall_status IS NOT NULL AND (replace(n.overall_status, 'error', 'unknown') IS DISTINCT FROM c.health_status
  OR coalesce(n.checked_at, c.last_health_check_at) IS DISTINCT FROM c.last_health_check_at) THEN {now} ELSE c.updated_at END AS updated_at FROM clients c LEFT JOIN n ON n.client_id = c.id""")
def _(t):
    new = lifecycle.refresh_health_status(t.clients, t.site_health_checks)
    columns = ["health_status", "last_health_check_at"]
    return lifecycle.touch_updated_at(t.clients, new, "id", columns, AS_OF).select("id", "updated_at")


@query("refresh_health_status", """
WITH n AS (SELECT client_id, if(overall_status = 'error', 'unknown', overall_status) AS s, checked_at FROM site_health_checks QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY checked_at DESC NULLS FIRST, id) = 1)
SELECT c.id, coalesce(n.s, c.health_status) AS health_status, coalesce(n.checked_at, c.last_health_check_at) AS last_health_check_at FROM clients c LEFT JOIN n ON n.client_id = c.id""")
def _(t):
    return lifecycle.refresh_health_status(t.clients, t.site_health_checks).select("id", "health_status", "last_health_check_at")


def _cascaded(t):
    gone = t.deleted_sites.select(F.col("original_client_id").alias("client_id"))
    key = lambda df: df.select("id", "client_id")
    owned = {"site_deployments": key(t.site_deployments), "site_health_checks": key(t.site_health_checks)}
    linked = {"platform_inventory": key(t.platform_inventory), "registry_operations_log": key(t.registry_operations_log)}
    return lifecycle.cascade_delete(gone, owned, linked)


@query("cascade_delete", """
WITH gone AS (SELECT original_client_id AS gid FROM deleted_sites)
SELECT 'site_deployments' AS table_name, id, client_id FROM site_deployments WHERE client_id NOT IN (SELECT gid FROM gone)
UNION ALL SELECT 'site_health_checks', id, client_id FROM site_health_checks WHERE client_id NOT IN (SELECT gid FROM gone)
UNION ALL SELECT 'platform_inventory', id, CASE WHEN client_id IN (SELECT gid FROM gone) THEN NULL ELSE client_id END FROM platform_inventory
UNION ALL SELECT 'registry_operations_log', id, CASE WHEN client_id IN (SELECT gid FROM gone) THEN NULL ELSE client_id END FROM registry_operations_log""")
def _(t):
    out = None
    for name, df in _cascaded(t).items():
        rows = df.select(F.lit(name).alias("table_name"), "id", "client_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("backfill_defaults", """
WITH r AS (SELECT request_id, contact_email, if(mode = 'INTAKE', NULL, 'blog') AS website_type, if(project_name = 'client-1', NULL, 'active') AS status FROM generation_requests)
SELECT request_id, coalesce(contact_email, '') AS contact_email, coalesce(website_type, 'marketing') AS website_type, coalesce(status, 'pending_provisioning') AS status FROM r""")
def _(t):
    rows = t.generation_requests.select(
        "request_id", "contact_email", F.when(F.col("mode") != "INTAKE", "blog").alias("website_type"),
        F.when(F.col("project_name") != "client-1", "active").alias("status"),
    )
    return lifecycle.backfill_defaults(rows)


@query("evolve_schema", """
SELECT id, client_slug, builder_space_mode, 'unknown' AS site_state, NULL::varchar AS notes FROM clients""")
def _(t):
    new = {
        "builder_space_mode": ("string", "DEDICATED"), "site_state": ("string", "unknown"), "notes": ("string", None),
    }
    return lifecycle.evolve_schema(t.clients.select("id", "client_slug", "builder_space_mode"), new)


@query("delete_by_slug", "SELECT id, client_slug FROM clients WHERE client_slug NOT IN (SELECT json_extract_string(client_data, '$.client_slug') FROM deleted_sites)")
def _(t):
    slugs = t.deleted_sites.select(json_text(F.col("client_data"), "client_slug").alias("client_slug"))
    return lifecycle.delete_by_slug(t.clients, slugs).select("id", "client_slug")


@query("update_operations", """
SELECT id, CASE WHEN completed_at IS NULL AND started_at IS NOT NULL THEN 90000 ELSE duration_ms END AS duration_ms FROM registry_operations_log""")
def _(t):
    old = t.registry_operations_log
    closed = F.coalesce("completed_at", F.col("started_at") + F.expr("INTERVAL 90 SECONDS"))
    new = old.withColumn("completed_at", closed)
    return lifecycle.update_operations(old, new, duration_ms(F.col("started_at"), F.col("completed_at"))).select("id", "duration_ms")


# Sources and sinks.  Each of these writes what Spark derives from the given
# tables to the shared work folder and reads it back through the library.

def _digest_columns(name: str) -> list[str]:
    made = set(re.findall(r"\bAS (\w+)", TABLE_SQL[name]))
    names = [column.split(" ")[0] for column in TABLES[name].split(", ")]
    return [f"coalesce(cast({c} AS varchar), '~')" if c in made else "'~'" for c in names]


def _digest_sql(name: str) -> str:
    """Row count and an order-free digest over all declared columns as text."""
    row = f"md5(concat_ws('|', {', '.join(_digest_columns(name))}))"
    return f"SELECT '{name}' AS table_name, count(*) AS row_count, cast(sum(cast('0x' || left({row}, 12) AS bigint)) AS varchar) AS digest FROM {name}"


@query("scan_table", "\nUNION ALL ".join(_digest_sql(name) for name in TABLES))
def _(t):
    root = work_dir(t.spark, "tables")
    out = None
    for name in TABLES:
        registry.write_table(getattr(t, name), root, name)
        rows = registry.scan_table(t.spark, root, name)
        texts = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in rows.columns]
        number = F.conv(F.left(F.md5(F.concat_ws("|", *texts)), F.lit(12)), 16, 10).cast("decimal(20,0)")
        digest = rows.agg(F.count("*").alias("row_count"), F.sum(number).cast("string").alias("digest"))
        digest = digest.select(F.lit(name).alias("table_name"), "row_count", "digest")
        out = digest if out is None else out.unionByName(digest)
    return out


@query("scan_table_rows", """
SELECT id, client_name, client_slug, builder_shared_space_id::varchar AS builder_shared_space_id, array_to_string(tags, '|') AS tags, last_health_check_at, NULL::varchar AS metadata FROM clients""")
def _(t):
    root = work_dir(t.spark, "clients")
    registry.write_table(t.clients, root, "clients")
    return registry.scan_table(t.spark, root, "clients").select(
        "id", "client_name", "client_slug", "builder_shared_space_id", "tags", "last_health_check_at", "metadata"
    )


DUCKDB_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "VARCHAR[]": "array<string>", "TIMESTAMP": "timestamp_ntz",
    "BOOLEAN": "boolean",
}
TYPE_CASE = "CASE column_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DUCKDB_TYPES.items()) + " END"
EXPECTED_CLIENTS = ", ".join("('{}', '{}')".format(*column.split(" ")) for column in TABLES["clients"].split(", "))
OBSERVED_CLIENTS = f"""
nulls AS (SELECT column_name, null_count FROM (UNPIVOT (SELECT count(*) - count(COLUMNS(*)) FROM clients) ON COLUMNS(*) INTO NAME column_name VALUE null_count)),
typed AS (SELECT cast(row_number() OVER () AS int) AS position, column_name, {TYPE_CASE} AS data_type FROM (DESCRIBE SELECT * FROM clients)),
seen AS (SELECT position, column_name, data_type, null_count FROM typed JOIN nulls USING (column_name))"""


@query("schema_listing", f"WITH {OBSERVED_CLIENTS} SELECT * FROM seen")
def _(t):
    return registry.schema_listing(t.clients, null_counts=True).select("position", "column_name", "data_type", "null_count")


@query("schema_diff", f"""
WITH {OBSERVED_CLIENTS}, expected AS (SELECT * FROM (VALUES {EXPECTED_CLIENTS}) v(name, expected_type))
SELECT coalesce(column_name, name) AS column_name, data_type, expected_type, null_count,
 CASE WHEN data_type IS NULL THEN 'missing' WHEN expected_type IS NULL THEN 'unexpected' WHEN data_type <> expected_type THEN 'type_differs' ELSE 'ok' END AS state
FROM seen FULL OUTER JOIN expected ON name = column_name""")
def _(t):
    return registry.schema_diff(t.clients, "clients")


@query("repo_snapshot", """
SELECT 'client-' || c_custkey AS name, 'fleet/client-' || c_custkey AS full_name, c_custkey % 2 = 0 AS private, c_nationkey IN (3, 11) AS archived,
 timestamp '2024-01-31 00:00:00' - (c_custkey % 300) * INTERVAL 1 MINUTE AS created_at, c_custkey * 10 AS size, 'main' AS default_branch FROM customer""")
def _(t):
    folder = work_dir(t.spark, "repositories")
    keys = F.regexp_extract("client_slug", "([0-9]+)$", 1).cast("bigint")
    t.clients.select(
        F.col("client_slug").alias("name"), F.col("github_repo").alias("full_name"), (keys % 2 == 0).alias("private"),
        (F.col("status") == "deleted").alias("archived"), "created_at", (keys * 10).alias("size"), F.lit("main").alias("default_branch"),
    ).write.json(folder)
    return snapshots.repo_snapshot(t.spark, folder).select(
        "name", "full_name", "private", "archived", "created_at", "size", "default_branch"
    )


@query("project_snapshot", """
SELECT DISTINCT p.vercel_project_id AS id, r.project_name AS project_id, p.client_slug AS name, CASE WHEN p.id IS NULL THEN 'Project not found: ' || r.project_name END AS error
FROM generation_requests r LEFT JOIN clients p ON p.client_slug = r.project_name""")
def _(t):
    folder = work_dir(t.spark, "projects")
    t.clients.select(F.col("vercel_project_id").alias("id"), F.col("client_slug").alias("name"), F.lit("nextjs").alias("framework")).write.json(folder)
    projects = snapshots.project_snapshot(t.spark, folder)
    wanted = t.generation_requests.select(F.col("project_name").alias("project_id"))
    return snapshots.project_details(projects, wanted).select("id", "project_id", "name", "error")


@query("message_ingest", """
WITH j AS (SELECT *, json_valid(value) AS good, CASE WHEN json_valid(value) THEN value END AS doc FROM onboarding_messages)
SELECT offset_id, json_extract_string(doc, '$.clientId') AS client_id, json_extract_string(doc, '$.clientSlug') AS client_slug, json_extract_string(doc, '$.tier') AS tier,
 json_extract_string(doc, '$.metadata.initiatedBy') AS initiated_by, json_extract_string(doc, '$.builder.spaceId') AS space_id, CASE WHEN NOT good THEN value END AS rejected FROM j""")
def _(t):
    return messages.parse_messages(t.onboarding_messages).select(
        "offset_id", F.col("clientId").alias("client_id"), F.col("clientSlug").alias("client_slug"), "tier",
        F.col("metadata.initiatedBy").alias("initiated_by"), F.col("builder.spaceId").alias("space_id"), "rejected",
    )


@query("append_generation_log", """
SELECT created_at, project_name, industry, cast(components_generated AS int) AS components_generated, cast(files_generated AS int) AS files_generated,
 generation_time_seconds::double AS generation_time_seconds, success, error_message, deployment_url, build_state, NULL::varchar AS build_logs FROM site_generations""")
def _(t):
    folder = work_dir(t.spark, "generation-log")
    writers.append_generation_log(t.site_generations.withColumn("generation_time_seconds", F.col("generation_time_seconds").cast("double")), folder)
    from fleetspark.schemas import GENERATION_LOG_COLUMNS, table_schema
    return t.spark.read.schema(table_schema("site_generations")).parquet(folder).select(*GENERATION_LOG_COLUMNS)


@query("insert_clients", """
WITH f AS (SELECT * FROM onboarding_forms WHERE client_slug NOT IN (SELECT client_slug FROM clients) QUALIFY row_number() OVER (PARTITION BY client_slug ORDER BY form_id) = 1)
SELECT client_name, client_slug, contact_email, website_type, tier AS builder_space_tier, if(tier = 'entry', 'SHARED', 'DEDICATED') AS builder_space_mode,
 if(tier = 'entry', 'shared-intake', NULL) AS gcp_project_id, 'pending_provisioning' AS status, 'client-' || client_slug || '-builder-public-key' AS builder_public_key,
 industry, {now} AS created_at, {now} AS updated_at, 1::bigint AS with_id FROM f""")
def _(t):
    folder = work_dir(t.spark, "new-clients")
    writers.insert_clients(t.onboarding_forms, t.clients, ["form_id"], folder, AS_OF)
    return t.spark.read.schema(registry.table_schema("clients")).parquet(folder).withColumn("with_id", F.count("id").over(Window.partitionBy("id"))).select(
        "client_name", "client_slug", "contact_email", "website_type", "builder_space_tier", "builder_space_mode",
        "gcp_project_id", "status", "builder_public_key", "industry", "created_at", "updated_at", "with_id",
    )


@query("publish_messages", """
SELECT 'm-' || form_id AS client_id, client_slug, client_name, contact_email, website_type, tier, 'onboarding-form' AS initiated_by, '2024-01-31T00:00:00' AS requested_at,
 tier <> 'entry' AS has_keys, CASE WHEN tier <> 'entry' THEN builder_public_key END AS public_key, CASE WHEN tier <> 'entry' THEN coalesce(builder_space_id, '') END AS space_id FROM onboarding_forms""")
def _(t):
    folder = work_dir(t.spark, "messages")
    made = messages.onboarding_messages(t.onboarding_forms, F.concat(F.lit("m-"), F.col("form_id").cast("string")), moment(AS_OF))
    messages.publish(made, {"path": folder})
    sent = t.spark.read.text(folder)
    key = lambda k: json_text(F.col("value"), k)
    return sent.select(
        key("clientId").alias("client_id"), key("clientSlug").alias("client_slug"), key("clientName").alias("client_name"),
        key("contactEmail").alias("contact_email"), key("websiteType").alias("website_type"), key("tier").alias("tier"),
        key("metadata.initiatedBy").alias("initiated_by"), key("metadata.requestedAt").alias("requested_at"),
        F.contains("value", F.lit('"builder":')).alias("has_keys"), key("builder.publicKey").alias("public_key"), key("builder.spaceId").alias("space_id"),
    )


@query("publish_provisioning_messages", """
SELECT id AS client_id, client_slug, website_type, builder_space_tier AS tier, 'site-generator' AS initiated_by, staging_url, github_repo, NULL::varchar AS space_id, NULL::varchar AS rejected
FROM clients WHERE status = 'active'""")
def _(t):
    folder = work_dir(t.spark, "provisioning")
    active = t.clients.filter(F.col("status") == "active")
    messages.publish(messages.provisioning_messages(active, moment(AS_OF)), {"path": folder})
    return messages.parse_messages(t.spark.read.text(folder)).select(
        F.col("clientId").alias("client_id"), F.col("clientSlug").alias("client_slug"), F.col("websiteType").alias("website_type"),
        "tier", F.col("metadata.initiatedBy").alias("initiated_by"), F.col("metadata.stagingUrl").alias("staging_url"),
        F.col("metadata.githubRepo").alias("github_repo"), F.col("builder.spaceId").alias("space_id"), "rejected",
    )


def _file_records(t):
    parsed = parse_response_files(t.generated_responses)
    slug = F.concat(F.lit("client-"), (F.col("doc_id") % 20).cast("string")).alias("project_name")
    return parsed.select("doc_id", slug, F.inline("files")).withColumn("path", F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("path"))).drop("doc_id")


@query("write_backups", """
SELECT 'client-' || (doc_id % 20) AS project_name, '20240131-000000' AS generation_ts, doc_id || '/components/Hero' || doc_id || '.tsx' AS path, text AS content FROM documents
UNION ALL SELECT 'client-' || (doc_id % 20), '20240131-000000', doc_id || '/package.json', source FROM documents WHERE NOT (doc_id % 5 = 0 AND doc_id % 4 > 1)""")
def _(t):
    folder = work_dir(t.spark, "backups")
    writers.write_backups(_file_records(t), folder, AS_OF)
    schema = "path string, content string, project_name string, generation_ts string"
    return t.spark.read.schema(schema).parquet(folder).select("project_name", "generation_ts", "path", "content")


@query("backup_metadata", """
WITH r AS (SELECT 'client-' || (doc_id % 20) AS project_name, text AS content FROM documents
UNION ALL SELECT 'client-' || (doc_id % 20), source FROM documents WHERE NOT (doc_id % 5 = 0 AND doc_id % 4 > 1))
SELECT project_name, 'projects/' || project_name || '/generation-20240131-000000.zip' AS name, 'gs://site-backups/projects/' || project_name || '/generation-20240131-000000.zip' AS backup_url,
 count(*) AS files, cast(sum(strlen(content)) AS bigint) AS bytes FROM r GROUP BY project_name""")
def _(t):
    return writers.backup_metadata(_file_records(t), AS_OF)


@query("issue_tokens", "SELECT md5(client_slug) AS token, client_slug, {now} AS created_at, {now} + INTERVAL 24 HOUR AS expires_at, false AS used FROM clients")
def _(t):
    return writers.issue_tokens(t.clients, AS_OF, F.md5("client_slug"))


@query("snapshot_rows", """
SELECT id AS original_client_id, client_slug, client_name, status, health_status, github_repo, contact_email, 0 AS missing FROM clients""")
def _(t):
    rows = lifecycle.snapshot_rows(t.clients)
    key = lambda k: json_text(F.col("client_data"), k).alias(k)
    keys = F.json_object_keys("client_data")
    return rows.select(
        "original_client_id", *[key(k) for k in ("client_slug", "client_name", "status", "health_status", "github_repo", "contact_email")],
        (F.lit(len(t.clients.columns)) - F.size(keys)).alias("missing"),
    )


@query("list_backups_of_deleted", """
SELECT b.client_slug, b.name, b.created_at FROM backups b WHERE b.client_slug IN (SELECT json_extract_string(client_data, '$.client_slug') FROM deleted_sites)""")
def _(t):
    slugs = t.deleted_sites.select(json_text(F.col("client_data"), "client_slug").alias("client_slug"))
    return topk.list_backups(t.backups.join(slugs, "client_slug", "left_semi")).select("client_slug", "name", "created_at")
