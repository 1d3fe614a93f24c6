"""Registry tables derived from the given test tables.

The library works on a registry of client sites; the test data is a star schema.
Each text below derives one registry table from it.  A text runs unchanged in
DuckDB and, with ``timestamp`` literals read as TIMESTAMP_NTZ, in Spark.
"""

TABLE_SQL = {
    "clients": """
SELECT concat('c-', lpad(cast(c_custkey AS varchar(20)), 8, '0')) AS id, c_name AS client_name,
 concat('client-', cast(c_custkey AS varchar(20))) AS client_slug,
 concat('owner', cast(c_custkey AS varchar(20)), '@example.com') AS contact_email,
 CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'marketing' WHEN 'BUILDING' THEN 'ecommerce' WHEN 'FURNITURE' THEN 'documentation' WHEN 'HOUSEHOLD' THEN 'portfolio' ELSE 'blog' END AS website_type,
 CASE WHEN c_acctbal < 3000 THEN 'entry' WHEN c_acctbal < 7000 THEN 'premium' ELSE 'enterprise' END AS builder_space_tier,
 CASE WHEN c_acctbal < 3000 THEN 'SHARED' ELSE 'DEDICATED' END AS builder_space_mode,
 CASE WHEN c_acctbal < 3000 THEN c_custkey % 25 END AS builder_shared_space_id,
 CASE WHEN c_nationkey IN (3, 11) THEN 'deleted' WHEN c_custkey % 5 = 0 THEN 'pending_provisioning' WHEN c_custkey % 5 = 1 THEN 'provisioning' WHEN c_custkey % 5 = 4 THEN 'suspended' ELSE 'active' END AS status,
 CASE c_custkey % 7 WHEN 0 THEN 'down' WHEN 1 THEN 'degraded' WHEN 2 THEN 'unknown' WHEN 3 THEN NULL ELSE 'healthy' END AS health_status,
 CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE timestamp '2024-01-31 00:00:00' - (c_custkey % 40) * INTERVAL '1' HOUR END AS last_health_check_at,
 CASE WHEN c_nationkey IN (3, 11) THEN timestamp '2024-01-15 00:00:00' END AS deletion_scheduled_at,
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE split('vip,eu', ',') END AS tags,
 timestamp '2024-01-31 00:00:00' - (c_custkey % 300) * INTERVAL '1' MINUTE AS created_at,
 timestamp '2024-01-31 00:00:00' - (c_custkey % 90) * INTERVAL '1' MINUTE AS updated_at,
 concat('prj_', cast(c_custkey AS varchar(20))) AS vercel_project_id, concat('https://client-', cast(c_custkey AS varchar(20)), '.vercel.app') AS staging_url,
 concat('client-', cast(c_custkey AS varchar(20)), '-builder-space-id') AS builder_space_id, lower(c_mktsegment) AS industry,
 concat('fleet/client-', cast(c_custkey AS varchar(20))) AS github_repo FROM customer
""",
    "site_deployments": """
SELECT o_orderkey AS id, concat('c-', lpad(cast(o_custkey AS varchar(20)), 8, '0')) AS client_id, md5(cast(o_orderkey AS varchar(20))) AS commit_sha,
 CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderdate END AS deployed_at, CASE WHEN o_orderkey % 4 = 0 THEN 'manual' ELSE 'auto' END AS deployed_by,
 CASE o_orderkey % 3 WHEN 0 THEN 'initial' WHEN 1 THEN 'update' ELSE 'regeneration' END AS deployment_trigger,
 CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'in_progress' ELSE 'failed' END AS status,
 CASE o_orderstatus WHEN 'F' THEN 'READY' WHEN 'O' THEN 'BUILDING' ELSE 'ERROR' END AS build_state, concat('dpl_', cast(o_orderkey AS varchar(20))) AS vercel_deployment_id,
 concat('https://client-', cast(o_custkey AS varchar(20)), '.vercel.app') AS staging_url, (o_orderkey % 7 = 0) AS rolled_back FROM orders
""",
    "site_health_checks": """
SELECT event_id AS id, concat('c-', lpad(cast(user_id AS varchar(20)), 8, '0')) AS client_id, CASE WHEN event_id % 1009 = 0 THEN NULL ELSE ts END AS checked_at,
 CASE event_type WHEN 'error' THEN 'down' WHEN 'signup' THEN 'degraded' WHEN 'purchase' THEN 'error' ELSE 'healthy' END AS overall_status,
 CASE WHEN event_id % 3 = 0 THEN 'down' ELSE 'healthy' END AS github_status, CASE WHEN event_id % 5 = 0 THEN 'down' ELSE 'healthy' END AS vercel_status,
 CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'healthy' END AS builder_status, CASE WHEN event_id % 7 = 0 THEN 'degraded' ELSE 'healthy' END AS gcs_status,
 CASE WHEN event_id % 11 = 0 THEN 'down' ELSE 'healthy' END AS staging_url_status, cast(value * 10 AS decimal(12,2)) AS response_ms FROM events
""",
    "platform_inventory": """
SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'github' WHEN '2-HIGH' THEN 'vercel' WHEN '3-MEDIUM' THEN 'builder' WHEN '4-NOT SPECIFIED' THEN 'gcs' ELSE 'supabase' END AS platform,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'repository' WHEN '2-HIGH' THEN 'project' WHEN '3-MEDIUM' THEN 'space' WHEN '4-NOT SPECIFIED' THEN 'backup' ELSE 'client' END AS resource_type,
 concat('res-', cast(o_orderkey AS varchar(20))) AS resource_id, concat('client-', cast(o_custkey AS varchar(20))) AS resource_name,
 CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE concat('c-', lpad(cast(o_custkey AS varchar(20)), 8, '0')) END AS client_id,
 concat('client-', cast(o_custkey AS varchar(20))) AS client_slug, o_orderdate AS discovered_at, timestamp '2024-01-31 00:00:00' - (o_orderkey % 90) * INTERVAL '1' HOUR AS last_verified_at,
 (o_orderkey % 18 = 0) AS is_orphaned, (o_orderkey % 10 = 3 OR o_orderkey % 36 = 0) AS is_drift, concat('https://res.example/', cast(o_orderkey AS varchar(20))) AS resource_url,
 concat('{"last_commit_sha":"', md5(cast(o_orderkey AS varchar(20))), '","deployment_state":"READY","content_count":', cast(o_orderkey % 50 AS varchar(20)), ',"backup_count":', cast(o_orderkey % 13 AS varchar(20)), ',"latest_backup_at":null}') AS resource_metadata
 FROM orders
""",
    "deleted_sites": """
SELECT c_custkey AS id, concat('c-', lpad(cast(c_custkey AS varchar(20)), 8, '0')) AS original_client_id,
 concat('{"client_slug":"client-', cast(CASE WHEN c_custkey % 7 = 3 THEN c_custkey - 1 WHEN c_custkey % 7 = 4 THEN c_custkey - c_custkey % 35 ELSE c_custkey END AS varchar(20)), '","client_name":"', c_name, '","builder_space_tier":"premium","builder_space_mode":"DEDICATED","industry":"', lower(c_mktsegment), '","github_repo":"fleet/client-', cast(c_custkey AS varchar(20)), '","tags":["vip"],"deletion_scheduled_at":"2024-01-15T00:00:00"}') AS client_data,
 timestamp '2024-01-30 12:00:00' - (c_custkey % 45) * INTERVAL '1' DAY AS deleted_at,
 CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN timestamp '2024-01-30 12:00:00' - (c_custkey % 45) * INTERVAL '1' DAY - INTERVAL '1' DAY
 ELSE timestamp '2024-01-30 12:00:00' - (c_custkey % 45) * INTERVAL '1' DAY + INTERVAL '30' DAY END AS recovery_deadline, concat('admin', cast(c_custkey % 3 AS varchar(20))) AS deleted_by, CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE 'contract ended' END AS deletion_reason,
 (c_custkey % 2 = 0) AS github_deleted, (c_custkey % 3 = 0) AS vercel_deleted, (c_custkey % 5 = 0) AS builder_deleted, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 7 = 0 END AS gcs_deleted,
 (c_custkey % 5 = 1) AS recovered, CASE WHEN c_custkey % 5 = 1 THEN timestamp '2024-01-30 18:00:00' END AS recovered_at,
 CASE WHEN c_custkey % 10 = 1 THEN concat('c-', lpad(cast(c_custkey AS varchar(20)), 8, '0')) WHEN c_custkey % 5 = 1 THEN concat('lost-', cast(c_custkey AS varchar(20))) END AS new_client_id,
 (c_custkey % 13 = 0) AS permanently_deleted, CASE WHEN c_custkey % 13 = 0 THEN timestamp '2024-01-30 20:00:00' END AS permanently_deleted_at FROM customer WHERE c_nationkey IN (3, 11)
""",
    "onboarding_tokens": """
SELECT o_orderkey AS id, md5(concat('t', cast(o_orderkey AS varchar(20)))) AS token, concat('client-', cast(o_custkey AS varchar(20))) AS client_slug,
 timestamp '2024-01-29 00:00:00' + (o_orderkey % 48) * INTERVAL '1' HOUR AS created_at, timestamp '2024-01-30 00:00:00' + (o_orderkey % 48) * INTERVAL '1' HOUR AS expires_at, (o_orderkey % 3 = 0) AS used FROM orders
""",
    "registry_operations_log": """
SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'update' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'deploy' ELSE 'health_check' END AS operation_type,
 CASE WHEN event_id % 500 = 1 THEN 'lost' WHEN event_id % 5 = 0 THEN 'success' WHEN event_id % 5 = 1 THEN 'failed' WHEN event_id % 5 = 2 THEN 'partial_success' WHEN event_id % 5 = 3 THEN 'in_progress' ELSE 'started' END AS operation_status,
 concat('c-', lpad(cast(user_id AS varchar(20)), 8, '0')) AS client_id, concat('client-', cast(user_id AS varchar(20))) AS client_slug, CASE WHEN event_id % 1013 = 0 THEN NULL ELSE ts END AS started_at, CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts + (event_id % 977) * INTERVAL '1' SECOND END AS completed_at,
 CASE WHEN event_id % 3 = 0 THEN 'auto' ELSE 'admin' END AS initiated_by,
 CASE event_id % 4 WHEN 0 THEN '{"success":true}' WHEN 1 THEN '{"success":false}' WHEN 2 THEN '{"success":null}' END AS github_result,
 CASE WHEN event_id % 5 = 0 THEN '{"success":"true"}' ELSE '{"error":"x"}' END AS vercel_result,
 CASE WHEN event_id % 3 = 0 THEN '{"success":true,"pages":3}' END AS builder_result, CASE WHEN event_id % 7 < 3 THEN '{"success":true}' WHEN event_id % 7 = 3 THEN '{"success":false}' END AS gcs_result, CASE WHEN event_id % 2 = 0 THEN '{"success":true}' END AS supabase_result,
 CASE WHEN event_id % 9 = 0 THEN NULL ELSE cast((event_id % 977) * 1000 AS int) END AS duration_ms, cast(event_id % 5 AS int) AS success_count, cast(event_id % 3 AS int) AS failure_count, CASE WHEN event_id % 2 = 0 THEN 'api' ELSE 'scheduled' END AS trigger_source,
 CASE WHEN event_id % 6 = 0 THEN split('e1,e2', ',') WHEN event_id % 6 = 1 THEN split('e1', ',') END AS error_messages,
 CASE WHEN event_id % 50 = 0 AND event_id > 0 THEN event_id - 1 END AS rollback_operation_id FROM events
""",
    "builderio_query_audit": """
SELECT event_id AS id, ts AS audit_ts, CASE event_type WHEN 'view' THEN 'get_content' WHEN 'click' THEN 'list_content' ELSE 'create_content' END AS operation, CASE event_id % 3 WHEN 0 THEN 'client_page' WHEN 1 THEN 'page' ELSE 'client_section' END AS model,
 CASE WHEN event_id % 10 = 0 THEN NULL ELSE concat('client-', cast(user_id AS varchar(20))) END AS client_slug, (event_id % 10 <> 0) AS has_client_slug_filter, CASE WHEN event_id % 10 = 0 THEN 'UNSAFE' ELSE 'SAFE' END AS security_level, concat('/p/', cast(event_id % 30 AS varchar(20))) AS url_path, CASE WHEN event_id % 2 = 0 THEN 'SHARED' ELSE 'DEDICATED' END AS space_mode FROM events
""",
    "builderio_shared_spaces": """
SELECT n_nationkey AS id, n_name AS space_name, concat('space-', cast(n_nationkey AS varchar(20))) AS space_id, concat('pub-', cast(n_nationkey % 24 AS varchar(20))) AS public_key, CASE n_regionkey WHEN 0 THEN 'entry' WHEN 1 THEN 'premium' ELSE 'enterprise' END AS tier, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 100 * (n_nationkey % 4) END AS max_clients, CASE WHEN n_nationkey % 9 = 6 THEN NULL ELSE n_nationkey % 7 END AS active_clients, timestamp '2024-01-01 00:00:00' AS updated_at, CASE WHEN n_nationkey % 5 = 4 THEN 'disabled' ELSE 'active' END AS status FROM nation
""",
    "site_generations": """
SELECT event_id AS id, ts AS created_at, concat('client-', cast(user_id AS varchar(20))) AS project_name, CASE event_type WHEN 'signup' THEN 'real-estate' WHEN 'click' THEN 'saas' WHEN 'error' THEN 'ecommerce' WHEN 'purchase' THEN 'healthcare' ELSE 'restaurant' END AS industry, event_id % 12 AS components_generated, event_id % 12 + 7 AS files_generated, cast(value AS decimal(10,2)) AS generation_time_seconds, (event_id % 6 <> 0) AS success,
 CASE event_id % 24 WHEN 0 THEN concat('Vercel build failed', chr(10), 'Build logs: ', cast(event_id AS varchar(20)), ' x ') WHEN 6 THEN 'GitHub API error: 422' WHEN 12 THEN 'BuilderIO timeout' WHEN 18 THEN 'boom' END AS error_message,
 CASE WHEN event_id % 6 <> 0 THEN concat('https://client-', cast(user_id AS varchar(20)), '.vercel.app') END AS deployment_url, CASE WHEN event_id % 6 <> 0 THEN 'READY' END AS build_state FROM events
""",
    "backups": """
SELECT concat('projects/client-', cast(o_custkey AS varchar(20)), '/generation-', cast(o_orderkey AS varchar(20)), '.zip') AS name, concat('client-', cast(o_custkey AS varchar(20))) AS client_slug, cast(floor(o_totalprice) AS bigint) AS size_bytes, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END AS created_at FROM orders
""",
    "build_events": """
SELECT event_id, user_id AS deployment_id, ts AS created_at, CASE event_type WHEN 'error' THEN 'stderr' WHEN 'purchase' THEN 'error' ELSE 'stdout' END AS type, CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('line ', cast(event_id AS varchar(20)), CASE WHEN event_id % 2 = 0 THEN ' Failed' ELSE '' END) END AS text FROM events
""",
    "hosts": """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat('client-', cast(page_id AS varchar(20)), '.sites.example') WHEN 1 THEN concat('test-client-', cast(page_id AS varchar(20)), '-kszvvxbwu-team-projects.vercel.app') WHEN 2 THEN concat('client-', cast(page_id AS varchar(20)), '.vercel.app') WHEN 3 THEN 'localhost:3000' WHEN 4 THEN concat('Bad_', cast(page_id AS varchar(20)), '.sites.example') ELSE split_part(split_part(url, '/', 3), ':', 1) END AS host FROM pages
""",
    "generated_responses": """
SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN concat('Here:', chr(10), '```json', chr(10)) WHEN 1 THEN concat('```', chr(10)) ELSE '' END, '{', chr(10), '  "files": [', chr(10), '    {"path":"components/Hero', cast(doc_id AS varchar(20)), '.tsx","content":"', replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n')), '"},', chr(10), '    {"path":"package.json","content":"', source, '"}', CASE WHEN doc_id % 5 = 0 THEN concat(',', chr(10), '    {"path":"lib/bu') ELSE concat(chr(10), '  ]', chr(10), '}') END, CASE WHEN doc_id % 4 < 2 AND doc_id % 5 <> 0 THEN concat(chr(10), '```') ELSE '' END) AS response_text FROM documents
""",
    "content_entries": """
SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'page' WHEN 1 THEN 'section' WHEN 2 THEN 'blog-post' WHEN 3 THEN 'client-page' WHEN 4 THEN 'symbol' ELSE 'product' END AS model, concat('client-', cast(doc_id % 20 AS varchar(20))) AS requested_slug, CASE WHEN doc_id % 12 < 6 THEN concat('shared-', cast(doc_id % 4 AS varchar(20))) ELSE concat('own-client-', cast(doc_id % 20 AS varchar(20))) END AS space_id, concat('{"clientSlug":"client-', cast(CASE WHEN doc_id % 37 = 0 THEN 99 ELSE doc_id % 20 END AS varchar(20)), '","urlPath":"/', lang, '/src', cast(doc_id % 4 AS varchar(20)), '/","env":"', CASE WHEN doc_id % 3 = 0 THEN 'staging' ELSE 'entry' END, '"}') AS data FROM documents
""",
    "onboarding_forms": """
SELECT c_custkey AS form_id, CASE c_custkey % 6 WHEN 0 THEN '' ELSE c_name END AS client_name, CASE c_custkey % 5 WHEN 0 THEN concat('  ', c_name, ' _', c_mktsegment, '- ') WHEN 1 THEN '-x-' WHEN 2 THEN 'ab' ELSE concat('client-', cast(c_custkey AS varchar(20))) END AS client_slug, CASE c_custkey % 4 WHEN 0 THEN 'bad@x' ELSE concat('o', cast(c_custkey AS varchar(20)), '@example.com') END AS contact_email, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'marketing' WHEN 'BUILDING' THEN 'ecommerce' ELSE lower(c_mktsegment) END AS website_type, CASE WHEN c_acctbal < 3000 THEN 'entry' ELSE 'premium' END AS tier, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('pub-', md5(c_name)) ELSE 'short' END AS builder_public_key, CASE c_custkey % 3 WHEN 0 THEN '' ELSE md5(c_name) END AS builder_private_key, CASE WHEN c_custkey % 4 <> 2 THEN concat('sp-', cast(c_custkey AS varchar(20))) END AS builder_space_id, CASE WHEN c_custkey % 5 <> 2 THEN lower(c_mktsegment) END AS industry FROM customer
""",
    "observed_resources": """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'github' WHEN '2-HIGH' THEN 'vercel' WHEN '3-MEDIUM' THEN 'builder' WHEN '4-NOT SPECIFIED' THEN 'gcs' ELSE 'supabase' END AS platform,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'repository' WHEN '2-HIGH' THEN 'project' WHEN '3-MEDIUM' THEN 'space' WHEN '4-NOT SPECIFIED' THEN 'backup' ELSE 'client' END AS resource_type,
 concat('res-', cast(CASE WHEN o_orderkey % 13 = 5 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS varchar(20))) AS resource_id, concat('client-', cast(o_custkey AS varchar(20))) AS resource_name
 FROM orders
""",
    "env_desired": """
SELECT concat('client-', cast(p_partkey % 100 AS varchar(20))) AS project, concat('KEY_', cast(p_partkey AS varchar(20))) AS key, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_brand END AS value FROM part
""",
    "env_existing": """
SELECT concat('env-', cast(p_partkey AS varchar(20))) AS id, concat('client-', cast(p_partkey % 100 AS varchar(20))) AS project, concat('KEY_', cast(CASE WHEN p_size > 12 THEN p_partkey + 1000000000 ELSE p_partkey END AS varchar(20))) AS key FROM part
""",
    "deployment_polls": """
SELECT event_id, cast(floor(event_id / 7) AS bigint) AS deployment_id, timestamp '2024-01-01 00:00:00' + cast(floor(event_id / 7) AS bigint) * INTERVAL '1' MINUTE + (event_id % 7) * INTERVAL '70' SECOND AS polled_at,
 CASE WHEN event_type = 'purchase' AND value > 60 THEN 'READY' WHEN event_type = 'error' AND value > 90 THEN 'ERROR' WHEN event_type = 'signup' AND value > 120 THEN 'CANCELED' WHEN event_type = 'click' THEN 'QUEUED' ELSE 'BUILDING' END AS ready_state FROM events
""",
    "onboarding_messages": """
SELECT c_custkey AS offset_id, CASE WHEN c_custkey % 50 = 7 THEN '{broken' ELSE concat('{"clientId":"m-', cast(c_custkey AS varchar(20)), '","clientSlug":"client-', cast(c_custkey AS varchar(20)), '","clientName":"', c_name, '","tier":"', CASE WHEN c_acctbal < 3000 THEN 'entry' ELSE 'premium' END, '","metadata":{"initiatedBy":"onboarding-form"}', CASE WHEN c_acctbal < 3000 THEN '' ELSE ',"builder":{"publicKey":"pub-x","spaceId":"s"}' END, '}') END AS value FROM customer
""",
    "token_submissions": """
SELECT l_orderkey AS order_id, l_linenumber AS attempt, md5(concat('t', cast(CASE WHEN l_returnflag = 'R' THEN l_orderkey + 1000000000 ELSE l_orderkey END AS varchar(20)))) AS token FROM lineitem
""",
    "space_deltas": """
SELECT event_id AS id, cast(user_id % 25 AS int) AS space_id, ts AS requested_at, CASE event_type WHEN 'signup' THEN 2 WHEN 'purchase' THEN 1 WHEN 'view' THEN -1 WHEN 'click' THEN -2 ELSE 0 END AS delta FROM events
""",
    "build_logs": """
SELECT doc_id AS deployment_id, replace(replace(replace(text, '. ', chr(10)), 'in ', 'Failed '), 'th ', 'ERROR ') AS build_logs FROM documents
""",
    "edit_requests": """
SELECT event_id AS request_id, concat('client-', cast(user_id AS varchar(20))) AS client_slug, CASE event_id % 10 WHEN 0 THEN 'color_palette' WHEN 1 THEN 'content' WHEN 2 THEN 'typography' WHEN 3 THEN 'layout' WHEN 4 THEN 'animation' WHEN 5 THEN 'add_section' WHEN 6 THEN 'fix_bug' WHEN 7 THEN 'update_images' WHEN 8 THEN 'seo' ELSE 'other' END AS edit_type FROM events
""",
    "content_requests": """
SELECT event_id AS request_id, concat('client-', cast(user_id % 21 AS varchar(20))) AS client_slug, CASE WHEN event_id % 2 = 0 THEN 'SHARED' ELSE 'DEDICATED' END AS space_mode, CASE WHEN event_id % 2 = 0 THEN concat('shared-', cast(user_id % 21 % 4 AS varchar(20))) ELSE concat('own-client-', cast(user_id % 21 AS varchar(20))) END AS space_id, CASE WHEN event_id % 16 = 15 THEN '/none' ELSE concat('/', CASE WHEN event_id % 3 = 0 THEN 'de' ELSE 'en' END, '/src', cast(user_id % 21 % 4 AS varchar(20)), '/') END AS url_path, CASE WHEN event_id % 3 = 0 THEN 'staging' ELSE 'entry' END AS env FROM events
""",
    "generation_requests": """
SELECT event_id AS request_id, concat('client-', cast(user_id * CASE WHEN event_id % 5 = 0 THEN 1000003 ELSE 1 END AS varchar(20))) AS project_name, CASE WHEN event_id % 7 = 0 THEN NULL ELSE concat('req', cast(user_id AS varchar(20)), '@example.com') END AS contact_email, CASE WHEN event_id % 4 = 0 THEN 'INTAKE' ELSE 'DEDICATED' END AS mode FROM events
""",
}
