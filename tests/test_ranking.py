"""Order, nulls and ties of newest-row queries, and that hot keys stay spread."""

from datetime import datetime

from fleetspark.operators import joins, topk
from fleetspark.plans import views
from fleetspark.plans.ranking import newest_first, nth_per_key, top_per_key

DAY = lambda d: datetime(2024, 1, d)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_null_time_is_newest_and_ties_go_to_smaller_id(spark):
    df = spark.createDataFrame(
        [(3, "a", DAY(2)), (1, "a", None), (4, "b", DAY(5)), (2, "b", DAY(5)), (5, "b", DAY(1))],
        "id long, k string, at timestamp_ntz",
    )
    assert sorted(ids(top_per_key(df, ["k"], newest_first("at", "id")))) == [1, 2]
    assert sorted(ids(nth_per_key(df, ["k"], newest_first("at", "id"), 2))) == [3, 4]
    ranked = top_per_key(df, ["k"], newest_first("at", "id"), 2, rank="n")
    assert sorted((r["id"], r["n"]) for r in ranked.collect()) == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_limit_per_key_is_applied_before_the_shuffle(spark, tables):
    plan = topk.get_latest_health(tables.site_health_checks)._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before_shuffle


def test_latest_deployment_is_null_if_a_good_one_has_no_time(spark):
    df = spark.createDataFrame(
        [(1, "a", DAY(2), "success", False), (2, "a", None, "success", False), (3, "b", DAY(3), "success", False),
         (4, "b", DAY(9), "success", True), (5, "b", DAY(8), "failed", False), (6, "c", None, "failed", False)],
        "id long, client_id string, deployed_at timestamp_ntz, status string, rolled_back boolean",
    )
    got = {r["client_id"]: r["latest_deployment_at"] for r in joins.latest_deployment_at(df).collect()}
    assert got == {"a": None, "b": DAY(3)}


def test_severity_order(spark):
    rows = [("healthy", DAY(1)), (None, DAY(1)), ("down", DAY(9)), ("down", None), ("unknown", DAY(1)), ("degraded", DAY(2)), ("odd", DAY(1))]
    df = spark.createDataFrame([(f"s{i}", h, t) for i, (h, t) in enumerate(rows)], "client_slug string, health_status string, last_health_check_at timestamp_ntz")
    assert [r["client_slug"] for r in views.by_severity(df).collect()] == ["s3", "s2", "s5", "s4", "s0", "s1", "s6"]


def test_views_come_in_order(tables):
    from fleetspark.catalog.tables import AS_OF

    orphans = [r["discovered_at"] for r in views.orphaned_resources(tables.platform_inventory, AS_OF).collect()]
    assert orphans == sorted(orphans, reverse=True)
    deployed = [r["deployed_at"] for r in views.deployment_history(tables.site_deployments, tables.clients, AS_OF).collect()]
    gaps = [d is None for d in deployed]
    assert gaps == sorted(gaps, reverse=True)
    known = [d for d in deployed if d]
    assert known == sorted(known, reverse=True)


def test_recent_operations_keeps_order_and_limit(tables):
    rows = views.recent_operations(tables.registry_operations_log).collect()
    assert len(rows) == 100
    times = [r["started_at"] for r in rows]
    assert times == sorted(times, key=lambda t: (t is not None, -(t or DAY(1)).timestamp()))


def test_backup_retention_variants(spark):
    df = spark.createDataFrame(
        [("p/1", "a", 5, DAY(1)), ("p/2", "a", 7, None), ("p/3", "a", 9, DAY(3)), ("p/4", "b", 1, None)],
        "name string, client_slug string, size_bytes long, created_at timestamp_ntz",
    )
    assert sorted(r["name"] for r in topk.backup_retention(df).collect()) == ["p/1", "p/2"]
    assert topk.backup_retention(df, keep_latest=False).count() == 4
    plan = {r["client_slug"]: (r["deleted_count"], r["freed_bytes"], r["kept_backup"]) for r in topk.backup_retention_summary(df).collect()}
    assert plan == {"a": (2, 12, "p/3"), "b": (0, None, "p/4")}
    assert [r["name"] for r in topk.list_backups(df, "a").collect()] == ["p/3", "p/1", "p/2"]
