"""Schemas of the registry tables and exchanged records, never inferred from data."""

from pyspark.sql import types as T

TABLES = {
    "clients": (
        "id string, client_name string, client_slug string, contact_email string, website_type string, "
        "builder_public_key string, builder_private_key string, builder_space_id string, industry string, "
        "status string, created_at timestamp_ntz, updated_at timestamp_ntz, onboarding_token_used string, "
        "provisioned_at timestamp_ntz, github_repo string, staging_url string, builder_space_mode string, "
        "builder_shared_space_id string, builder_space_tier string, health_status string, "
        "last_health_check_at timestamp_ntz, vercel_project_id string, deletion_scheduled_at timestamp_ntz, "
        "tags array<string>, metadata string, gcp_project_id string"
    ),
    "builderio_shared_spaces": (
        "id string, space_name string, space_id string, public_key string, private_key_secret_name string, "
        "gcp_project_id string, tier string, max_clients int, active_clients int, status string, "
        "created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "builderio_query_audit": (
        "id string, audit_ts timestamp_ntz, operation string, model string, client_slug string, "
        "has_client_slug_filter boolean, security_level string, url_path string, space_mode string, "
        "created_at timestamp_ntz"
    ),
    "onboarding_tokens": (
        "id string, token string, client_slug string, created_at timestamp_ntz, expires_at timestamp_ntz, "
        "used boolean, used_at timestamp_ntz"
    ),
    "site_deployments": (
        "id string, client_id string, commit_sha string, vercel_deployment_id string, deployed_at timestamp_ntz, "
        "deployed_by string, deployment_trigger string, status string, build_state string, build_logs string, "
        "staging_url string, production_url string, rolled_back boolean, rolled_back_at timestamp_ntz, "
        "rollback_reason string"
    ),
    "deleted_sites": (
        "id string, original_client_id string, client_data string, deleted_at timestamp_ntz, deleted_by string, "
        "deletion_reason string, recovery_deadline timestamp_ntz, github_deleted boolean, "
        "github_deletion_result string, vercel_deleted boolean, vercel_deletion_result string, "
        "builder_deleted boolean, builder_deletion_result string, gcs_deleted boolean, gcs_deletion_result string, "
        "recovered boolean, recovered_at timestamp_ntz, recovered_by string, new_client_id string, "
        "permanently_deleted boolean, permanently_deleted_at timestamp_ntz"
    ),
    "site_health_checks": (
        "id string, client_id string, checked_at timestamp_ntz, check_duration_ms int, overall_status string, "
        "github_status string, github_repo_exists boolean, github_last_commit_at timestamp_ntz, "
        "github_open_issues_count int, github_details string, vercel_status string, "
        "vercel_deployment_state string, vercel_ssl_valid boolean, vercel_last_deployment_at timestamp_ntz, "
        "vercel_details string, builder_status string, builder_space_accessible boolean, "
        "builder_content_count int, builder_details string, gcs_status string, gcs_backup_exists boolean, "
        "gcs_latest_backup_at timestamp_ntz, gcs_backup_count int, gcs_details string, staging_url_status string, "
        "staging_url_http_code int, staging_url_response_time_ms int, staging_url_accessible boolean, "
        "staging_url_details string"
    ),
    "platform_inventory": (
        "id string, platform string, resource_type string, resource_id string, resource_name string, "
        "client_id string, client_slug string, discovered_at timestamp_ntz, last_verified_at timestamp_ntz, "
        "resource_metadata string, is_orphaned boolean, is_drift boolean, verification_error string, "
        "resource_url string"
    ),
    "registry_operations_log": (
        "id string, operation_type string, operation_status string, client_id string, client_slug string, "
        "started_at timestamp_ntz, completed_at timestamp_ntz, duration_ms int, initiated_by string, "
        "trigger_source string, github_result string, vercel_result string, builder_result string, "
        "gcs_result string, supabase_result string, success_count int, failure_count int, "
        "error_messages array<string>, can_rollback boolean, rolled_back boolean, rollback_operation_id string, "
        "request_payload string, response_payload string, notes string"
    ),
    "site_generations": (
        "id bigint, created_at timestamp_ntz, project_name string, industry string, components_generated int, "
        "files_generated int, generation_time_seconds decimal(10,2), success boolean, error_message string, "
        "deployment_url string, build_state string, build_logs string"
    ),
}
# The given test tables that registry tables are derived from.
GIVEN = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
        "o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    ),
    "pages": "page_id bigint, url string, html string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}
GENERATION_LOG_COLUMNS = [
    "created_at", "project_name", "industry", "components_generated", "files_generated", "generation_time_seconds",
    "success", "error_message", "deployment_url", "build_state", "build_logs",
]
REPOSITORY = (
    "name string, full_name string, html_url string, private boolean, archived boolean, created_at timestamp_ntz, "
    "updated_at timestamp_ntz, pushed_at timestamp_ntz, size bigint, default_branch string"
)
PROJECT = "id string, name string, framework string, accountId string, createdAt bigint, updatedAt bigint"
BACKUP_OBJECT = (
    "name string, client_slug string, size_bytes bigint, created_at timestamp_ntz, updated_at timestamp_ntz, url string, "
    "public_url string"
)
MESSAGE = (
    "clientId string, clientSlug string, clientName string, contactEmail string, websiteType string, tier string, "
    "metadata struct<initiatedBy: string, onboardingSource: string, requestedAt: string, supabaseClientId: string, "
    "stagingUrl: string, githubRepo: string>, "
    "builder struct<publicKey: string, privateKey: string, spaceId: string>"
)


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])
