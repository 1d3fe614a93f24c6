"""Physical plans over stored tables: what is read, pushed, shuffled and run in Python."""

import re

import pytest

from fleetspark import catalog
from fleetspark.catalog.tables import AS_OF
from fleetspark.operators import filters, joins, quality
from fleetspark.plans import views
from fleetspark.session import work_dir
from fleetspark.sources import registry


@pytest.fixture(scope="module")
def stored(spark, tables):
    root = work_dir(spark, "plans")
    for name in ("clients", "site_deployments", "site_health_checks", "platform_inventory", "onboarding_tokens", "registry_operations_log"):
        registry.write_table(getattr(tables, name), root, name)
    return lambda name: registry.scan_table(spark, root, name)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text):
    return [set(re.findall(r"(\w+):", found)) for found in re.findall(r"ReadSchema: struct<(.*?)>(?:\s|$)", text)]


def test_filters_reach_the_files(stored):
    text = plan(views.orphaned_resources(stored("platform_inventory"), AS_OF))
    assert "EqualNullSafe(is_orphaned,true)" in text and "EqualNullSafe(is_drift,false)" in text
    text = plan(filters.active_tokens(stored("onboarding_tokens"), AS_OF))
    assert "EqualNullSafe(used,false)" in text and "GreaterThan(expires_at" in text
    text = plan(views.client_full_inventory(stored("clients"), stored("platform_inventory"), stored("site_deployments"), stored("site_health_checks")))
    for platform in ("github", "vercel", "builder", "gcs"):
        assert f"EqualTo(platform,{platform})" in text
    assert "IsNull(deletion_scheduled_at)" in text


def test_wide_columns_are_not_read(stored):
    text = plan(views.health_summary(stored("clients"), stored("site_health_checks"), AS_OF))
    read = set().union(*read_columns(text))
    assert "overall_status" not in read and "github_details" not in read and "metadata" not in read
    text = plan(joins.latest_deployment_at(stored("site_deployments")))
    assert read_columns(text) == [{"client_id", "deployed_at", "status", "rolled_back"}]


def test_global_limit_is_no_full_sort(spark, stored):
    from conftest import SMALL

    limited = [catalog.QUERIES[name](spark, SMALL) for name in ("content_query", "list_sites", "recent_100", "recent_operations")]
    for df in [views.recent_operations(stored("registry_operations_log")), *limited]:
        text = plan(df)
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text, text


def test_sql_functions_cut_rows_before_the_shuffle(spark, stored):
    from conftest import SMALL

    catalog.QUERIES["view_counts_sql"](spark, SMALL)
    for text in (
        "SELECT * FROM get_latest_health('c-00000001')", "SELECT c.client_slug, h.* FROM clients c, LATERAL get_latest_health(c.id) h",
        "SELECT * FROM get_client_operation_history('client-1', 3)", "SELECT c.client_slug, h.* FROM clients c, LATERAL get_client_operation_history(c.client_slug, 3) h",
    ):
        assert "WindowGroupLimit" in plan(spark.sql(text)), text


def test_unordered_views_save_the_sort(stored):
    args = (stored("site_deployments"), stored("clients"), AS_OF)
    assert "rangepartitioning" in plan(views.deployment_history(*args))
    assert "rangepartitioning" not in plan(views.deployment_history(*args, ordered=False))


def test_rules_of_a_table_take_one_scan(stored):
    text = plan(quality.check_violations({"registry_operations_log": stored("registry_operations_log")}))
    assert text.count("FileScan") == 1 and "Exchange" not in text


def test_no_python_in_batch_plans(spark):
    from conftest import SMALL

    for name in ("client_full_inventory", "parse_response_files", "validate_forms", "host_to_slug", "apply_space_deltas", "generation_metrics", "archive_batch"):
        assert "Python" not in plan(catalog.QUERIES[name](spark, SMALL)), name
        assert "Nested" not in plan(catalog.QUERIES[name](spark, SMALL)), name
