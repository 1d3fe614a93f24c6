"""Registered queries: text and record functions."""

from pyspark.sql import functions as F

from fleetspark.catalog.registry import query
from fleetspark.catalog.tables import AS_OF
from fleetspark.functions import forms, responses, text
from fleetspark.functions.records import changed, clamped, computed_once

CANDIDATE = """
cand AS (SELECT doc_id, nullif(CASE
  WHEN contains(response_text, '```json') THEN trim(split_part(split_part(response_text, '```json', 2), '```', 1), ' ' || chr(10))
  WHEN contains(response_text, '```') THEN trim(split_part(response_text, '```', 2), ' ' || chr(10))
  WHEN contains(response_text, '{') AND contains(response_text, '"files"') THEN regexp_extract(response_text, '(?s)[{].*[}]') END, '') AS body FROM generated_responses),
fixed AS (SELECT doc_id, body, json_valid(body) AS good, regexp_extract(body, '(?s)^(.*)[}],\n    [{]', 1) || '}' || chr(10) || '  ]' || chr(10) || '}' AS cut,
  regexp_matches(body, '(?s)[}],\n    [{]') AND contains(body, '"files": [') AS cuttable FROM cand),
parsed AS (SELECT doc_id, CASE WHEN body IS NULL THEN 'no_json' WHEN good THEN 'parsed' WHEN cuttable AND json_valid(cut) THEN 'repaired' ELSE 'malformed' END AS parse_state,
  CASE WHEN good THEN body WHEN cuttable AND json_valid(cut) THEN cut END AS doc FROM fixed),
listed AS (SELECT doc_id, parse_state, json_extract_string(doc, '$.files[*].path') AS paths, json_extract_string(doc, '$.files[*].content') AS contents, doc IS NOT NULL AS ok FROM parsed)"""


@query("sanitize_slug", """
WITH a AS (SELECT form_id, regexp_replace(lower(client_slug), '[\\s_]+', '-', 'g') AS s, client_slug AS raw FROM onboarding_forms)
SELECT form_id, trim(regexp_replace(regexp_replace(s, '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-') AS slug,
 regexp_replace(lower(raw), '[^a-z0-9-]', '', 'g') AS form_slug FROM a""")
def _(t):
    slug = F.col("client_slug")
    return t.onboarding_forms.select("form_id", text.sanitize_slug(slug).alias("slug"), text.form_slug(slug).alias("form_slug"))


@query("validate_forms", r"""
WITH f AS (SELECT *, trim(client_slug) = '' AS no_slug, NOT regexp_matches(client_slug, '^[a-z0-9][a-z0-9-]*[a-z0-9]\n?$') AS odd FROM onboarding_forms),
e AS (SELECT form_id, list_filter([
 CASE WHEN trim(client_name) = '' THEN 'Client Name is required' END, CASE WHEN no_slug THEN 'Client Slug is required' END,
 CASE WHEN trim(contact_email) = '' THEN 'Contact Email is required' END, CASE WHEN trim(website_type) = '' THEN 'Website Type is required' END,
 CASE WHEN tier <> 'entry' AND builder_public_key = '' THEN 'Builder.io Public Key is required' END, CASE WHEN tier <> 'entry' AND builder_private_key = '' THEN 'Builder.io Private Key is required' END,
 CASE WHEN client_slug = '' THEN NULL WHEN odd AND length(client_slug) > 2 THEN 'Client Slug must be lowercase, alphanumeric with hyphens only, and cannot start/end with a hyphen'
  WHEN length(client_slug) < 3 THEN 'Client Slug must be at least 3 characters' WHEN length(client_slug) > 30 THEN 'Client Slug must be 30 characters or less' END,
 CASE WHEN contact_email <> '' AND NOT regexp_matches(contact_email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\n?$') THEN 'Please enter a valid email address' END,
 CASE WHEN website_type <> '' AND website_type NOT IN ('marketing', 'ecommerce', 'documentation', 'portfolio', 'blog') THEN 'Website Type must be one of: marketing, ecommerce, documentation, portfolio, blog' END,
 CASE WHEN builder_public_key = '' THEN NULL WHEN length(builder_public_key) < 20 THEN 'Builder.io Public Key appears to be invalid (too short)'
  WHEN NOT starts_with(builder_public_key, 'pub-') AND NOT regexp_matches(builder_public_key, '^[a-zA-Z0-9]+\n?$') THEN 'Builder.io Public Key must be either a legacy key (alphanumeric) or start with "pub-"' END,
 CASE WHEN builder_private_key <> '' AND length(builder_private_key) < 20 THEN 'Builder.io Private Key appears to be invalid (too short)' END
], lambda x: x IS NOT NULL) AS list FROM f)
SELECT form_id, array_to_string(list, '|') AS errors, len(list) = 0 AS is_valid FROM e""")
def _(t):
    errors = forms.form_errors()
    return t.onboarding_forms.select("form_id", errors.alias("errors")).withColumn("is_valid", F.size("errors") == 0)


@query("host_to_slug", r"""
WITH p AS (SELECT page_id, host, string_split(host, '.') AS labels, string_split(string_split(host, '.')[1], '-') AS segs FROM hosts),
q AS (SELECT *, list_position(list_transform(segs, lambda s: length(s) >= 8 AND regexp_matches(s, '^[a-z0-9]+$')), true) AS cut FROM p),
r AS (SELECT *, CASE WHEN contains(host, '.vercel.app') AND len(segs) > 3 AND cut > 1 THEN array_to_string(segs[1:cut - 1], '-') ELSE labels[1] END AS slug FROM q)
SELECT page_id, host, CASE WHEN contains(host, 'localhost') THEN 'development' WHEN len(labels) < 3 THEN NULL WHEN regexp_matches(slug, '^[a-z0-9-]+$') THEN slug END AS slug FROM r""")
def _(t):
    return t.hosts.select("page_id", "host", text.host_to_slug(F.col("host")).alias("slug"))


@query("url_path_segments", """
WITH p AS (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS segs FROM pages)
SELECT page_id, array_to_string(segs, '|') AS segments, '/' || array_to_string(segs, '/') AS path FROM p""")
def _(t):
    segments = text.path_segments(F.col("url"))
    return t.given("pages").select("page_id", segments.alias("segments"), text.segments_path(segments).alias("path"))


@query("display_name", """
SELECT id, array_to_string(list_transform(regexp_extract_all(lower(replace(client_slug, '-', ' ')), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '') AS name FROM clients""")
def _(t):
    return t.clients.select("id", text.display_name(F.col("client_slug")).alias("name"))


@query("classify_error", """
WITH k AS (SELECT id, CASE WHEN contains(error_message, 'Vercel') THEN 1 WHEN contains(error_message, 'Builder.io') OR contains(error_message, 'BuilderIO') THEN 2
  WHEN contains(error_message, 'GitHub') THEN 3 ELSE 4 END AS kind FROM site_generations WHERE error_message IS NOT NULL)
SELECT id, CASE kind WHEN 1 THEN 'Vercel deployment or API error' WHEN 2 THEN 'Builder.io API error' WHEN 3 THEN 'GitHub API error' ELSE 'Unexpected error during site generation' END AS message,
 CASE kind WHEN 1 THEN 'Check Vercel API token is valid|Verify project permissions|Review Vercel deployment logs'
 WHEN 2 THEN 'Check Builder.io API key is valid|Verify space permissions|Check Builder.io space quotas'
 WHEN 3 THEN 'Check GitHub token is valid|Verify repository permissions|Check rate limits'
 ELSE 'Review error logs|Check service configurations|Contact support if error persists' END AS next_steps FROM k""")
def _(t):
    failed = t.site_generations.filter(F.col("error_message").isNotNull())
    return failed.select("id", text.classify_error(F.col("error_message")).alias("h")).select("id", "h.message", "h.next_steps")


@query("extract_build_log", """
SELECT id, CASE WHEN contains(error_message, 'Build logs:') THEN trim(split_part(error_message, 'Build logs:', 2)) END AS build_logs,
 CASE WHEN contains(error_message, 'Build logs:') THEN 'ERROR' END AS build_state FROM site_generations""")
def _(t):
    return t.site_generations.select("id", text.extract_build_log(F.col("error_message")).alias("x")).select("id", "x.*")


@query("top_error_lines", """
WITH l AS (SELECT deployment_id, build_logs, list_filter(string_split(build_logs, chr(10)), lambda x: contains(lower(x), 'error') OR contains(lower(x), 'failed')) AS bad FROM build_logs)
SELECT deployment_id, len(bad) AS error_lines, 'Vercel build failed (state: ERROR)' || chr(10) || 'Error: Build failed on Vercel' || chr(10) || chr(10) || 'Build Errors:'
 || array_to_string(list_transform(bad[1:10], lambda x: chr(10) || '  ' || x), '')
 || CASE WHEN len(bad) > 10 THEN chr(10) || '  ... and ' || (len(bad) - 10)::varchar || ' more errors' ELSE '' END AS report FROM l""")
def _(t):
    logs = F.col("build_logs")
    found = computed_once(t.build_logs, _lines=text.error_lines(logs))
    report = text.build_failure_report(
        F.lit("ERROR"), F.lit(text.BUILD_FAILURES["ERROR"]), F.col("_lines"), F.coalesce(logs, F.lit("")) != ""
    )
    return found.select("deployment_id", F.size("_lines").cast("bigint").alias("error_lines"), report.alias("report"))


@query("build_outcome", """
SELECT event_id, ready_state, ready_state IN ('READY', 'ERROR', 'CANCELED') AS finished, CASE ready_state WHEN 'READY' THEN true WHEN 'ERROR' THEN false WHEN 'CANCELED' THEN false END AS success,
 CASE ready_state WHEN 'ERROR' THEN 'Build failed on Vercel' WHEN 'CANCELED' THEN 'Build was canceled' END AS error FROM deployment_polls""")
def _(t):
    return t.deployment_polls.select("event_id", "ready_state", text.build_outcome(F.col("ready_state")).alias("o")).select(
        "event_id", "ready_state", "o.*"
    )


@query("archived_name", """
SELECT id, 'ARCHIVED-' || resource_name AS archived, 'ARCHIVED-' || resource_name AS twice FROM platform_inventory WHERE platform = 'github'""")
def _(t):
    repos = t.platform_inventory.filter(F.col("platform") == "github")
    once = text.archived_name(F.col("resource_name"))
    return repos.select("id", once.alias("archived"), text.archived_name(once).alias("twice"))


@query("parse_response_files", f"""
WITH {CANDIDATE} SELECT doc_id, parse_state, array_to_string(paths, '|') AS paths, array_to_string(contents, '|') AS contents FROM listed""")
def _(t):
    parsed = responses.parse_response_files(t.generated_responses)
    return parsed.select("doc_id", "parse_state", F.col("files.path").alias("paths"), F.col("files.content").alias("contents"))


@query("component_names", f"""
WITH {CANDIDATE} SELECT doc_id, unnest(paths)[12:-5] AS component FROM (SELECT doc_id, list_filter(paths, lambda p: starts_with(p, 'components/') AND p LIKE '%.tsx') AS paths FROM listed)""")
def _(t):
    parsed = responses.parse_response_files(t.generated_responses)
    return parsed.select("doc_id", F.explode(responses.component_names(F.col("files"))).alias("component"))


@query("missing_files", f"""
WITH {CANDIDATE} SELECT doc_id, array_to_string(list_filter(['app/[[...page]]/page.tsx', 'app/layout.tsx', 'app/not-found.tsx', 'lib/builder.ts', 'package.json', 'tsconfig.json', 'vercel.json'],
 lambda p: NOT list_contains(paths, p)), '|') AS missing FROM listed WHERE ok""")
def _(t):
    parsed = responses.parse_response_files(t.generated_responses).filter(F.col("files").isNotNull())
    return parsed.select("doc_id", responses.missing_files(F.col("files")).alias("missing"))


@query("generation_counts", f"""
WITH {CANDIDATE} SELECT doc_id, len(paths) AS files, len(list_filter(paths, lambda p: starts_with(p, 'components/') AND p LIKE '%.tsx')) AS components FROM listed WHERE ok""")
def _(t):
    parsed = responses.parse_response_files(t.generated_responses).filter(F.col("files").isNotNull())
    return parsed.select(
        "doc_id", F.size("files").cast("bigint").alias("files"),
        F.size(responses.component_names(F.col("files"))).cast("bigint").alias("components"),
    )


@query("edit_files", """
WITH m AS (SELECT * FROM (VALUES ('color_palette', ['tailwind.config.ts', 'app/globals.css']), ('content', ['app/page.tsx']), ('typography', ['tailwind.config.ts', 'app/globals.css']),
 ('layout', ['app/page.tsx', 'tailwind.config.ts']), ('animation', ['app/page.tsx']), ('add_section', ['app/page.tsx']), ('fix_bug', ['app/page.tsx']), ('update_images', ['app/page.tsx']), ('seo', ['app/layout.tsx'])) v(kind, paths))
SELECT request_id, client_slug, edit_type, unnest(coalesce(m.paths, ['app/page.tsx'])) AS path FROM edit_requests LEFT JOIN m ON m.kind = edit_type""")
def _(t):
    return t.edit_requests.select("request_id", "client_slug", "edit_type", F.explode(responses.edit_files(F.col("edit_type"))).alias("path"))


@query("key_format", """
SELECT form_id, CASE WHEN builder_public_key = '' THEN 'missing' WHEN starts_with(builder_public_key, 'pub-') THEN 'candidate' ELSE 'invalid_format' END AS format,
 CASE WHEN builder_public_key = '' THEN 'None' ELSE builder_public_key[1:10] || '...' || right(builder_public_key, 4) END AS masked FROM onboarding_forms""")
def _(t):
    key = F.col("builder_public_key")
    return t.onboarding_forms.select("form_id", text.key_format(key).alias("format"), text.masked_key(key).alias("masked"))


@query("derive_client_record", """
SELECT form_id, client_name, client_slug, contact_email, website_type, tier AS builder_space_tier, if(tier = 'entry', 'SHARED', 'DEDICATED') AS builder_space_mode,
 if(tier = 'entry', 'shared-intake', NULL) AS gcp_project_id, 'pending_provisioning' AS status, 'client-' || client_slug || '-builder-public-key' AS builder_public_key,
 'client-' || client_slug || '-builder-private-key' AS builder_private_key, 'client-' || client_slug || '-builder-space-id' AS builder_space_id,
 industry, md5(concat_ws('|', client_slug, '{as_of}')) AS id, {now} AS created_at, {now} AS updated_at FROM onboarding_forms""".replace("{as_of}", AS_OF))
def _(t):
    return t.onboarding_forms.select("form_id", *forms.client_record(AS_OF)).withColumn("id", F.replace("id", F.lit("-"), F.lit("")))


@query("mode_to_space_and_model", """
SELECT request_id, mode, if(mode = 'INTAKE', 'SHARED', 'DEDICATED') AS space_mode, if(mode = 'INTAKE', 'client-page', 'page') AS model FROM generation_requests""")
def _(t):
    return t.generation_requests.select("request_id", "mode", forms.generation_space(F.col("mode")).alias("s")).select("request_id", "mode", "s.*")


@query("site_urls", """
SELECT id, 'https://' || client_slug || '.vercel.app' AS staging, 'https://' || client_slug || '.sites.example' AS production,
 'projects/' || client_slug || '/generation-' || strftime(created_at, '%Y%m%d-%H%M%S') || '.zip' AS backup,
 'gs://site-backups/projects/' || client_slug || '/generation-' || strftime(created_at, '%Y%m%d-%H%M%S') || '.zip' AS backup_url FROM clients""")
def _(t):
    slug = F.col("client_slug")
    name = text.backup_name(slug, F.col("created_at"))
    return t.clients.select(
        "id", text.staging_url(slug).alias("staging"), text.production_url(slug).alias("production"),
        name.alias("backup"), text.backup_url(name).alias("backup_url"),
    )


@query("changed", """
SELECT id, completed_at IS DISTINCT FROM started_at AS moved, github_result IS DISTINCT FROM vercel_result AS differs FROM registry_operations_log""")
def _(t):
    return t.registry_operations_log.select(
        "id", changed(F.col("completed_at"), F.col("started_at")).alias("moved"),
        changed(F.col("github_result"), F.col("vercel_result")).alias("differs"),
    )


@query("clamped_counter", """
SELECT d.id, greatest(0, s.active_clients + d.delta) AS active_clients FROM space_deltas d JOIN builderio_shared_spaces s ON s.id = d.space_id""")
def _(t):
    spaces = t.builderio_shared_spaces.select(F.col("id").alias("space_id"), "active_clients")
    return t.space_deltas.join(spaces, "space_id").select("id", clamped(F.col("active_clients"), F.col("delta")).alias("active_clients"))
