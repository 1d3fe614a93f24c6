"""Registered queries: joins, newest rows, retention."""

from pyspark.sql import functions as F

from fleetspark.catalog.registry import query
from fleetspark.catalog.tables import AS_OF
from fleetspark.functions.times import moment
from fleetspark.operators import joins, lifecycle, tenancy, topk
from fleetspark.session import work_dir
from fleetspark.sources import listing, writers
from fleetspark.plans.site_details import site_details, site_summary

GOOD = "good AS (SELECT * FROM site_deployments WHERE status = 'success' AND rolled_back = false)"
BACKUP_ORDER = "PARTITION BY client_slug ORDER BY created_at DESC NULLS LAST, name"


@query("slug_availability", """
SELECT f.form_id, f.client_slug, c.client_slug IS NULL AS available,
 CASE WHEN c.client_slug IS NOT NULL THEN format('Client slug ''{}'' is already in use by ''{}'' (status: {}). Please choose a different slug.', f.client_slug, c.client_name, c.status) END AS message
FROM onboarding_forms f LEFT JOIN clients c ON c.client_slug = f.client_slug""")
def _(t):
    return joins.slug_availability(t.onboarding_forms.select("form_id", "client_slug"), t.clients)


@query("unmatched_resources", """
SELECT id, platform, resource_id, client_id FROM platform_inventory p WHERE NOT EXISTS (SELECT 1 FROM clients c WHERE c.id = p.client_id)""")
def _(t):
    return joins.unmatched_resources(t.platform_inventory, t.clients).select("id", "platform", "resource_id", "client_id")


@query("orphan_was_deleted", """
SELECT id, client_slug, CASE WHEN client_slug IN (SELECT json_extract_string(client_data, '$.client_slug') FROM deleted_sites) THEN 'deleted' ELSE 'unknown' END AS origin
FROM platform_inventory WHERE is_orphaned""")
def _(t):
    orphans = t.platform_inventory.filter("is_orphaned").select("id", "client_slug")
    return joins.orphan_was_deleted(orphans, t.deleted_sites)


@query("shared_space_for_tier", """
WITH asked AS (SELECT DISTINCT builder_space_tier AS tier FROM clients),
act AS (SELECT tier, count(*) AS matches, min(id) AS id, min(space_id) AS space_id, min(space_name) AS space_name FROM builderio_shared_spaces WHERE status = 'active' GROUP BY tier)
SELECT asked.tier, if(matches = 1, id, NULL) AS space_key, if(matches = 1, space_id, NULL) AS space_id, if(matches = 1, space_name, NULL) AS space_name,
 matches, CASE WHEN matches = 1 THEN 'ok' WHEN matches > 1 THEN 'multiple rows' ELSE 'no rows' END AS reason FROM asked LEFT JOIN act ON act.tier = asked.tier""")
def _(t):
    tiers = t.clients.select(F.col("builder_space_tier").alias("tier")).distinct()
    return joins.shared_space_for_tier(tiers, t.builderio_shared_spaces)


@query("rollback_links", """
SELECT a.id AS operation_id, a.operation_type, a.client_slug, a.rollback_operation_id, b.operation_type AS rollback_type, b.started_at AS rollback_started_at
FROM registry_operations_log a LEFT JOIN registry_operations_log b ON a.rollback_operation_id = b.id WHERE a.rollback_operation_id IS NOT NULL""")
def _(t):
    return joins.rollback_links(t.registry_operations_log)


@query("client_fallback", """
SELECT r.request_id, r.project_name, r.mode, coalesce(c.id, md5(r.project_name)) AS client_id,
 CASE WHEN c.id IS NOT NULL THEN c.contact_email ELSE coalesce(r.contact_email, 'unknown@example.com') END AS contact_email
FROM generation_requests r LEFT JOIN clients c ON c.client_slug = r.project_name""")
def _(t):
    return joins.client_fallback(t.generation_requests, t.clients, F.md5("project_name"))


@query("generation_gate", """
SELECT r.request_id, r.project_name, c.status AS client_status, coalesce(c.status = 'active', false) AS allowed,
 CASE WHEN c.client_slug IS NULL THEN 'Client not found' WHEN c.status <> 'active' THEN 'Client not ready for site generation' END AS reason,
 CASE WHEN c.client_slug IS NULL THEN 'Please onboard the client first using the client_onboarding tool' WHEN c.status = 'active' THEN NULL
  WHEN c.status = 'pending_provisioning' THEN 'Wait for provisioning workflow to complete' ELSE 'Contact support' END AS recommendation
FROM generation_requests r LEFT JOIN clients c ON c.client_slug = r.project_name""")
def _(t):
    gated = joins.generation_gate(t.generation_requests.select("request_id", "project_name"), t.clients)
    return gated.select("request_id", "project_name", "client_status", "allowed", "reason", "recommendation")


@query("site_details", """
SELECT client_slug, 'site' AS kind, created_at AS at, id, client_name AS label, status FROM clients
UNION ALL SELECT c.client_slug, 'deployment', d.deployed_at, d.id::varchar, d.commit_sha, d.status FROM site_deployments d JOIN clients c ON c.id = d.client_id
UNION ALL SELECT c.client_slug, 'health_check', h.checked_at, h.id::varchar, NULL, h.overall_status FROM site_health_checks h JOIN clients c ON c.id = h.client_id
UNION ALL SELECT o.client_slug, 'operation', o.started_at, o.id::varchar, o.operation_type, o.operation_status FROM registry_operations_log o WHERE o.client_slug IN (SELECT client_slug FROM clients)""")
def _(t):
    return site_details(t.clients, t.site_deployments, t.site_health_checks, t.registry_operations_log)


@query("site_summary", """
WITH d AS (SELECT client_id, string_agg(coalesce(commit_sha, ''), '|' ORDER BY deployed_at DESC NULLS FIRST, id) AS shas, count(*) AS n FROM
  (SELECT * FROM site_deployments QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY deployed_at DESC NULLS FIRST, id) <= 10) GROUP BY client_id),
h AS (SELECT client_id, string_agg(overall_status, '|' ORDER BY checked_at DESC NULLS FIRST, id) AS states, count(*) AS n FROM
  (SELECT * FROM site_health_checks QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY checked_at DESC NULLS FIRST, id) <= 10) GROUP BY client_id),
o AS (SELECT client_slug, string_agg(operation_type, '|' ORDER BY started_at DESC NULLS FIRST, id) AS kinds, count(*) AS n FROM
  (SELECT * FROM registry_operations_log QUALIFY row_number() OVER (PARTITION BY client_slug ORDER BY started_at DESC NULLS FIRST, id) <= 10) GROUP BY client_slug)
SELECT c.client_slug, coalesce(d.shas, '') AS deployed_shas, coalesce(h.states, '') AS health_states, coalesce(o.kinds, '') AS operation_kinds,
 coalesce(d.n, 0) AS deployments, coalesce(h.n, 0) AS checks, coalesce(o.n, 0) AS operations
FROM clients c LEFT JOIN d ON d.client_id = c.id LEFT JOIN h ON h.client_id = c.id LEFT JOIN o ON o.client_slug = c.client_slug""")
def _(t):
    full = site_summary(t.clients, t.site_deployments, t.site_health_checks, t.registry_operations_log, 10)
    size = lambda c: F.size(c).cast("bigint")
    return full.select(
        "client_slug",
        F.array_join("deployments.commit_sha", "|").alias("deployed_shas"),
        F.array_join("health_history.overall_status", "|").alias("health_states"),
        F.array_join("operations.operation_type", "|").alias("operation_kinds"),
        size("deployments").alias("deployments"), size("health_history").alias("checks"), size("operations").alias("operations"),
    )


@query("inventory_reconcile", """
SELECT coalesce(o.platform, p.platform) AS platform, coalesce(o.resource_type, p.resource_type) AS resource_type, coalesce(o.resource_id, p.resource_id) AS resource_id,
 coalesce(o.resource_name, p.resource_name) AS resource_name, p.client_id,
 CASE WHEN p.resource_id IS NULL THEN 'orphaned' WHEN o.resource_id IS NULL THEN 'drift' ELSE 'matched' END AS state,
 p.resource_id IS NULL AS is_orphaned, o.resource_id IS NULL AS is_drift, CASE WHEN o.resource_id IS NULL THEN p.last_verified_at ELSE {now} END AS last_verified_at
FROM observed_resources o FULL OUTER JOIN platform_inventory p ON o.platform = p.platform AND o.resource_type = p.resource_type AND o.resource_id = p.resource_id""")
def _(t):
    return joins.inventory_reconcile(t.observed_resources, t.platform_inventory, moment(AS_OF))


@query("env_diff", """
SELECT d.project, d.key, d.value, CASE WHEN d.value IS NULL THEN 'skip' WHEN e.id IS NULL THEN 'create' ELSE 'update' END AS action, if(d.value IS NULL, NULL, e.id) AS existing_id
FROM env_desired d LEFT JOIN (SELECT project, key, min(id) AS id FROM env_existing GROUP BY ALL) e ON e.project = d.project AND e.key = d.key""")
def _(t):
    return joins.env_diff(t.env_desired, t.env_existing)


@query("get_latest_health", """
SELECT client_id, overall_status, checked_at, github_status, vercel_status, builder_status, gcs_status, staging_url_status FROM site_health_checks
QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY checked_at DESC NULLS FIRST, id) = 1""")
def _(t):
    return topk.get_latest_health(t.site_health_checks)


@query("operation_history", """
SELECT id, client_slug, operation_type, operation_status, started_at, duration_ms, initiated_by, success_count, failure_count FROM registry_operations_log
QUALIFY row_number() OVER (PARTITION BY client_slug ORDER BY started_at DESC NULLS FIRST, id) <= 50""")
def _(t):
    return topk.operation_history(t.registry_operations_log)


@query("latest_success", f"""
WITH {GOOD} SELECT id, client_id, commit_sha, deployed_at FROM good
QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY deployed_at DESC NULLS FIRST, id) = 1""")
def _(t):
    return topk.latest_success(t.site_deployments).select("id", "client_id", "commit_sha", "deployed_at")


@query("rollback_target", f"""
WITH {GOOD} SELECT id, client_id, commit_sha, deployed_at FROM good
QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY deployed_at DESC NULLS FIRST, id) = 2""")
def _(t):
    return topk.rollback_target(t.site_deployments)


@query("list_backups", "SELECT name, client_slug, size_bytes, created_at FROM backups")
def _(t):
    return topk.list_backups(t.backups)


@query("backup_listing", """
SELECT name, client_slug, size_bytes, created_at, len(string_split(name, '/'))::int - 1 AS depth, 'zip' AS suffix, 'gs://site-backups/' || name AS url FROM backups""")
def _(t):
    # The listing is exported twice, older objects first and with a size that changes later.
    root = work_dir(t.spark, "backup-listing")
    backups = t.backups.withColumns({"updated_at": F.col("created_at"), "url": F.concat(F.lit("gs://site-backups/"), F.col("name"))})
    older = F.col("size_bytes") % 3 > 0
    first = backups.where(older).withColumn("size_bytes", F.when(F.col("size_bytes") % 3 == 1, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    first.write.json(f"{root}/exports")
    listed = listing.Listing(t.spark, f"{root}/listing")
    listed.refresh_from_exports(f"{root}/exports")
    later = backups.where(~older | (F.col("size_bytes") % 3 == 1)).withColumn("updated_at", F.col("created_at") + F.expr("INTERVAL 1 DAY"))
    later.write.mode("append").json(f"{root}/exports")
    listed.refresh_from_exports(f"{root}/exports")
    return listing.described(listed.objects()).select("name", "client_slug", "size_bytes", "created_at", "depth", "suffix", "url")


@query("backup_files", """
SELECT client_slug, cast(sum(strlen(name) + 1) AS bigint) AS size_bytes, true AS named, 'gs://site-backups/projects/' || client_slug || '/' AS url_start FROM backups GROUP BY client_slug""")
def _(t):
    # One file per client, written below projects/ and listed from its metadata.
    root = work_dir(t.spark, "backup-files")
    writers.write_owner_texts(t.backups, f"{root}/projects", "client_slug", "name")
    listed = listing.Listing(t.spark, f"{root}/listing")
    listed.refresh_from_files(root)
    # As by Spark's writer a folder is named column=value.
    slug = F.regexp_replace("client_slug", "^client_slug=", "")
    named = F.col("name").startswith(F.concat(F.lit("projects/client_slug="), slug, F.lit("/part-"))) & F.col("created_at").isNotNull() & F.col("updated_at").isNotNull()
    url = F.regexp_replace(F.regexp_extract("url", "^(.*/)[^/]+$", 1), "client_slug=", "")
    return listed.objects().groupBy(slug.alias("client_slug")).agg(
        F.sum("size_bytes").alias("size_bytes"), F.bool_and(named).alias("named"), F.min(url).alias("url_start")
    )


@query("latest_backup", f"""
WITH b AS (SELECT * FROM backups QUALIFY row_number() OVER ({BACKUP_ORDER}) = 1)
SELECT c.client_slug, b.name AS backup_name, b.size_bytes, b.created_at AS backup_created_at,
 CASE WHEN b.name IS NULL THEN 'No backups found for ' || c.client_slug END AS error FROM clients c LEFT JOIN b ON b.client_slug = c.client_slug""")
def _(t):
    return topk.latest_backup(t.clients, t.backups)


@query("backup_retention", f"SELECT name, client_slug, size_bytes, created_at FROM backups QUALIFY row_number() OVER ({BACKUP_ORDER}) > 1")
def _(t):
    return topk.backup_retention(t.backups)


@query("backup_retention_summary", f"""
WITH r AS (SELECT *, row_number() OVER ({BACKUP_ORDER}) AS n FROM backups)
SELECT client_slug, count(*) - 1 AS deleted_count, cast(sum(if(n > 1, size_bytes, NULL)) AS bigint) AS freed_bytes, max(if(n = 1, name, NULL)) AS kept_backup FROM r GROUP BY client_slug""")
def _(t):
    return topk.backup_retention_summary(t.backups)


EXPIRY_SQL = """
WITH gone AS (SELECT json_extract_string(client_data, '$.client_slug') AS slug, coalesce(recovery_deadline, deleted_at + INTERVAL 30 DAY) AS deadline FROM deleted_sites WHERE NOT recovered),
due AS (SELECT slug, max(deadline) AS deadline FROM gone WHERE deadline < {now} AND slug NOT IN (SELECT client_slug FROM clients WHERE status <> 'deleted') GROUP BY slug)
SELECT b.client_slug, b.name, b.size_bytes, b.created_at, g.deadline FROM backups b JOIN due g ON g.slug = b.client_slug"""


@query("backup_expiry", EXPIRY_SQL)
def _(t):
    return topk.backup_expiry(t.backups, t.deleted_sites, t.clients, AS_OF)


@query("archive_batch", """
SELECT id, space_id, model, json_extract_string(data, '$.clientSlug') AS slug, json_extract_string(data, '$.urlPath') AS url_path, json_extract_string(data, '$.env') AS env,
 '2024-01-31T00:00:00' AS archived_at, 'true' AS archived FROM content_entries WHERE model IN ('page', 'section', 'blog-post', 'product', 'symbol')
QUALIFY row_number() OVER (PARTITION BY space_id, model ORDER BY id) <= 100""")
def _(t):
    batch = topk.archive_batch(t.content_entries, AS_OF)
    key = lambda k: F.get_json_object("data", f"$.{k}")
    return batch.select(
        "id", "space_id", "model", key("clientSlug").alias("slug"), key("urlPath").alias("url_path"), key("env").alias("env"),
        key("__archived_at").alias("archived_at"), key("__archived_for_deletion").alias("archived"),
    )


@query("archive_counts", """
SELECT space_id, model, least(count(*), 100) AS archived_count FROM content_entries WHERE model IN ('page', 'section', 'blog-post', 'product', 'symbol') GROUP BY ALL""")
def _(t):
    return topk.archive_counts(topk.archive_batch(t.content_entries, AS_OF))


@query("content_query", """
SELECT id, model, data FROM content_entries WHERE model = 'client-page' AND json_extract_string(data, '$.env') = 'staging' ORDER BY id LIMIT 20""")
def _(t):
    return tenancy.content_query(t.content_entries, "client-page", {"env": "staging"}).select("id", "model", "data")


@query("tenant_check", """
SELECT requested_slug, model, count(*) AS entries, count(*) FILTER (json_extract_string(data, '$.clientSlug') IS DISTINCT FROM requested_slug) AS invalid_entries
FROM content_entries GROUP BY ALL""")
def _(t):
    return tenancy.tenant_check(t.content_entries)


SCOPE_MODELS = {"SHARED": "client-page", "DEDICATED": "page"}


@query("tenant_scope", """
WITH e AS (SELECT id, space_id, model, json_extract_string(data, '$.clientSlug') AS slug, json_extract_string(data, '$.urlPath') AS path, json_extract_string(data, '$.env') AS env FROM content_entries)
SELECT r.request_id, r.space_mode, min(e.id) AS entry_id, 1::bigint AS position FROM content_requests r
JOIN e ON e.space_id = r.space_id AND e.path = r.url_path
 AND ((r.space_mode = 'DEDICATED' AND e.model = 'page') OR (r.space_mode = 'SHARED' AND e.model = 'client-page' AND e.slug = r.client_slug AND e.env = r.env)) GROUP BY ALL""")
def _(t):
    return tenancy.tenant_scope(t.content_requests, t.content_entries, SCOPE_MODELS)


@query("tenant_scope_list", """
WITH e AS (SELECT id, space_id, model, json_extract_string(data, '$.clientSlug') AS slug, json_extract_string(data, '$.env') AS env FROM content_entries),
s AS (SELECT space_id, slug, env, id FROM e WHERE model = 'client-page' QUALIFY row_number() OVER (PARTITION BY space_id, slug, env ORDER BY id) <= 100),
d AS (SELECT space_id, id FROM e WHERE model = 'page' QUALIFY row_number() OVER (PARTITION BY space_id ORDER BY id) <= 100)
SELECT r.request_id, r.space_mode, count(*) AS entries, cast(sum(s.id) AS bigint) AS entry_sum, max(s.id) AS last_entry FROM content_requests r
JOIN s ON s.space_id = r.space_id AND s.slug = r.client_slug AND s.env = r.env WHERE r.space_mode = 'SHARED' GROUP BY ALL
UNION ALL SELECT r.request_id, r.space_mode, count(*), cast(sum(d.id) AS bigint), max(d.id) FROM content_requests r JOIN d ON d.space_id = r.space_id WHERE r.space_mode = 'DEDICATED' GROUP BY ALL""")
def _(t):
    seen = tenancy.tenant_scope(t.content_requests, t.content_entries, SCOPE_MODELS, by_path=False)
    return seen.groupBy("request_id", "space_mode").agg(
        F.count("*").alias("entries"), F.sum("entry_id").alias("entry_sum"), F.max("entry_id").alias("last_entry")
    )


@query("token_validity", """
SELECT s.order_id, s.attempt, s.token, CASE WHEN k.token IS NULL THEN 'missing' WHEN k.used THEN 'used' WHEN k.expires_at < {now} THEN 'expired' ELSE 'valid' END AS validity,
 CASE WHEN NOT k.used AND k.expires_at >= {now} THEN k.client_slug END AS client_slug
FROM token_submissions s LEFT JOIN onboarding_tokens k ON k.token = s.token""")
def _(t):
    return lifecycle.token_validity(t.token_submissions, t.onboarding_tokens, AS_OF)
