"""Row changes on hand-made rows: boundaries, nulls, duplicates, agreement of output frames."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from fleetspark.operators import aggregates, filters, joins, lifecycle, tenancy, topk
from fleetspark.plans.site_details import site_details
from fleetspark.sources import writers

NOW = "2024-01-31 00:00:00"
AT = datetime(2024, 1, 31)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_token_boundary(spark):
    """At its very expiry a token counts as active, is accepted, but is not listed."""
    t = spark.createDataFrame([("t", "s", AT, AT, False), ("u", "s", AT, AT - timedelta(seconds=1), False), ("v", "s", AT, AT, True)],
                              "token string, client_slug string, created_at timestamp_ntz, expires_at timestamp_ntz, used boolean")
    assert rows(aggregates.token_status_counts(t, NOW), "status", "count") == [("active", 1), ("expired", 1), ("used", 1)]
    assert filters.active_tokens(t, NOW).count() == 0
    asked = spark.createDataFrame([("t",), ("u",), ("v",), ("x",)], "token string")
    assert rows(lifecycle.token_validity(asked, t, NOW), "token", "validity", "client_slug") == [
        ("t", "valid", "s"), ("u", "expired", None), ("v", "used", None), ("x", "missing", None)]
    assert rows(lifecycle.expire_tokens(t, NOW), "token") == [("t",), ("v",)]
    assert rows(lifecycle.consume_tokens(t, asked.limit(1)), "token", "used") == [("t", True), ("u", False), ("v", True)]


def test_issue_tokens(spark):
    asked = spark.createDataFrame([("a",), ("b",)], "client_slug string")
    made = writers.issue_tokens(asked, NOW).collect()
    assert len({r["token"] for r in made}) == 2 and all(len(r["token"]) == 64 for r in made)
    assert all(r["expires_at"] - r["created_at"] == timedelta(hours=24) and not r["used"] for r in made)


def test_mark_orphaned_counts_changes(spark):
    df = spark.createDataFrame([(1, None, False), (2, None, True), (3, "c", False), (4, None, None)], "id int, client_id string, is_orphaned boolean")
    seen = Observation("orphans")
    assert rows(lifecycle.mark_orphaned(df, seen), "id", "is_orphaned") == [(1, True), (2, True), (3, False), (4, None)]
    assert seen.get["updated"] == 1


def test_sync_inventory(spark):
    inventory = spark.createDataFrame([(1, "old", "a", True, AT), (2, "old", "gone", True, AT), (3, "x", "b", True, AT)],
                                      "id int, client_id string, client_slug string, is_orphaned boolean, last_verified_at timestamp_ntz")
    clients = spark.createDataFrame([("ida", "a"), ("idb", "b")], "id string, client_slug string")
    slugs = spark.createDataFrame([("a",), ("gone",), ("a",)], "client_slug string")
    assert rows(lifecycle.sync_inventory(inventory, clients, slugs, "2024-02-01 00:00:00"), "id", "client_id", "is_orphaned", "last_verified_at") == [
        (1, "ida", False, datetime(2024, 2, 1)), (2, None, False, datetime(2024, 2, 1)), (3, "x", True, AT)]


CLIENT = "id string, client_slug string, client_name string, status string, deletion_scheduled_at timestamp_ntz"


def test_soft_delete(spark):
    clients = spark.createDataFrame([("1", "a", "A", "active", None), ("2", "b", None, "active", None), ("3", "c", "C", "deleted", AT)], CLIENT)
    asked = spark.createDataFrame([("a", "me", "why"), ("a", "zed", "again"), ("b", "", "nobody"), ("c", "me", "late"), ("zz", "me", None)],
                                  "client_slug string, deleted_by string, reason string")
    changed, deleted, log = lifecycle.soft_delete(clients, asked, NOW)
    assert rows(changed, "id", "status", "deletion_scheduled_at") == [("1", "deleted", AT), ("2", "active", None), ("3", "deleted", AT)]
    assert rows(deleted, "original_client_id", "deleted_by", "recovery_deadline") == [("1", "me", AT + timedelta(days=30))]
    assert '"deletion_scheduled_at":null' in deleted.first()["client_data"]
    assert rows(log, "client_id", "operation_type", "initiated_by") == [("1", "delete", "me")]


def test_recover(spark):
    late, early = AT + timedelta(days=3), AT
    sites = spark.createDataFrame(
        [(1, "c1", '{"client_slug":"a","client_name":"A"}', AT, late, False, None, None, False), (2, "c2", '{"client_slug":"b"}', AT, early, False, None, None, False),
         (3, "c3", '{"client_slug":"c"}', AT, None, True, AT, "n", False), (4, "c4", '{"client_slug":"d"}', AT, late, False, None, None, True)],
        "id int, original_client_id string, client_data string, deleted_at timestamp_ntz, recovery_deadline timestamp_ntz, recovered boolean, "
        "recovered_at timestamp_ntz, new_client_id string, permanently_deleted boolean")
    assert rows(lifecycle.recovery_eligibility(sites, NOW), "id", "reason") == [
        (1, None), (2, "recovery window closed"), (3, "already recovered"), (4, "permanently deleted")]
    asked = spark.createDataFrame([("a", "me"), ("b", "me"), ("a", "you")], "client_slug string, recovered_by string")
    clients = spark.createDataFrame([("live",)], "client_slug string").withColumn("status", F.lit("active"))
    new, marked = lifecycle.recover(sites, asked, clients, NOW)
    made = rows(new, "client_slug", "client_name", "status", "id")
    assert [r[:3] for r in made] == [("a", "A", "active")]
    assert rows(marked.filter("id = 1"), "recovered", "new_client_id", "recovered_by") == [(True, made[0][3], "me")]
    assert rows(marked.filter("id > 1"), "id", "recovered", "new_client_id") == [(2, False, None), (3, True, "n"), (4, False, None)]
    assert rows(marked, "id", "recovery_error") == [(1, None), (2, "recovery window closed"), (3, None), (4, None)]


def test_recover_takes_the_whole_row_and_one_deletion_per_slug(spark):
    late = AT + timedelta(days=3)
    data = '{"client_slug":"%s","client_name":"A","builder_space_tier":"premium","tags":["x"],"metadata":"{}","github_repo":"r","status":"deleted","deletion_scheduled_at":"2024-01-01T00:00:00"}'
    gone = lambda i, slug, days: (i, f"c{i}", data % slug, AT - timedelta(days=days), late, False, None, None, False)
    sites = spark.createDataFrame([gone(1, "a", 2), gone(2, "a", 1), gone(3, "b", 1), gone(4, "a", 1)],
                                  "id int, original_client_id string, client_data string, deleted_at timestamp_ntz, recovery_deadline timestamp_ntz, recovered boolean, "
                                  "recovered_at timestamp_ntz, new_client_id string, permanently_deleted boolean")
    asked = spark.createDataFrame([("a", "me"), ("b", "me")], "client_slug string, recovered_by string")
    clients = spark.createDataFrame([("a", "deleted"), ("b", "active")], "client_slug string, status string")
    new, marked = lifecycle.recover(sites, asked, clients, NOW)
    row = new.first()
    assert new.count() == 1 and (row["original_client_id"], row["builder_space_tier"], row["tags"], row["github_repo"], row["status"], row["deletion_scheduled_at"]) == (
        "c2", "premium", ["x"], "r", "active", None)
    assert rows(marked, "id", "recovery_error") == [(1, "newer deletion recovered"), (2, None), (3, "slug in use"), (4, "newer deletion recovered")]


def test_backups_of_a_live_slug_do_not_expire(spark):
    sites = spark.createDataFrame([('{"client_slug":"a"}', AT, AT - timedelta(days=1), False), ('{"client_slug":"b"}', AT, AT - timedelta(days=1), False)],
                                  "client_data string, deleted_at timestamp_ntz, recovery_deadline timestamp_ntz, recovered boolean")
    backups = spark.createDataFrame([("a", "x"), ("b", "y")], "client_slug string, name string")
    clients = spark.createDataFrame([("a", "active"), ("b", "deleted")], "client_slug string, status string")
    assert rows(topk.backup_expiry(backups, sites, clients, NOW), "name") == [("y",)]


def test_purge_stages(spark):
    deadlines = [AT - timedelta(days=1), AT + timedelta(hours=20), AT + timedelta(days=7), AT + timedelta(days=8)]
    df = spark.createDataFrame([(i, "c", AT, d, False, False) for i, d in enumerate(deadlines)],
                               "id int, original_client_id string, deleted_at timestamp_ntz, recovery_deadline timestamp_ntz, recovered boolean, permanently_deleted boolean")
    assert rows(lifecycle.purge_due(df, NOW), "id", "stage") == [(0, "due"), (1, "warn_1_day"), (2, "warn_7_days"), (3, "waiting")]


def test_cascade(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, client_id string")
    out = lifecycle.cascade_delete(spark.createDataFrame([("a",)], "client_id string"), {"own": df}, {"link": df})
    assert rows(out["own"], "id", "client_id") == [(2, "b"), (3, None)]
    assert rows(out["link"], "id", "client_id") == [(1, None), (2, "b"), (3, None)]


def test_schema_and_defaults(spark):
    df = spark.createDataFrame([(1, None)], "id int, status string")
    new = lifecycle.evolve_schema(df, {"status": ("string", "x"), "tags": ("array<string>", None), "n": ("int", 3)})
    assert new.dtypes == [("id", "int"), ("status", "string"), ("tags", "array<string>"), ("n", "int")]
    assert rows(new, "id", "status", "n") == [(1, None, 3)]
    client = spark.createDataFrame([(None, None, None), ("e", "blog", "active")], "contact_email string, website_type string, status string")
    assert rows(lifecycle.backfill_defaults(client), "contact_email", "website_type", "status") == [("", "marketing", "pending_provisioning"), ("e", "blog", "active")]
    assert rows(lifecycle.delete_by_slug(spark.createDataFrame([("a",), (None,)], "client_slug string"), "a"), "client_slug") == [(None,)]


def test_touch_and_durations(spark):
    old = spark.createDataFrame([(1, "a", AT), (2, None, AT)], "id int, v string, updated_at timestamp_ntz")
    new = spark.createDataFrame([(1, "a", None), (2, "b", None)], "id int, v string, updated_at timestamp_ntz")
    assert rows(lifecycle.touch_updated_at(old, new, "id", ["v"], "2024-03-01 00:00:00"), "id", "updated_at") == [(1, AT), (2, datetime(2024, 3, 1))]


def test_refresh_health_maps_error_to_unknown(spark):
    clients = spark.createDataFrame([("a", "healthy", None), ("b", "down", AT)], "id string, health_status string, last_health_check_at timestamp_ntz")
    checks = spark.createDataFrame([(1, "a", "error", AT)], "id long, client_id string, overall_status string, checked_at timestamp_ntz")
    assert rows(lifecycle.refresh_health_status(clients, checks), "id", "health_status", "last_health_check_at") == [("a", "unknown", AT), ("b", "down", AT)]


def test_single_row_and_gate(spark):
    spaces = spark.createDataFrame([(1, "s1", "n", "entry", "active"), (2, "s2", "n", "premium", "active"), (3, "s3", "n", "premium", "active"), (4, "s4", "n", "enterprise", "disabled")],
                                   "id int, space_id string, space_name string, tier string, status string")
    tiers = spark.createDataFrame([("entry",), ("premium",), ("enterprise",)], "tier string")
    assert rows(joins.shared_space_for_tier(tiers, spaces), "tier", "space_id", "reason") == [
        ("enterprise", None, "no rows"), ("entry", "s1", "ok"), ("premium", None, "multiple rows")]
    clients = spark.createDataFrame([("a", "active", "1", "m"), ("b", None, "2", None)], "client_slug string, status string, id string, contact_email string")
    asked = spark.createDataFrame([("a", "q"), ("b", "q"), ("c", None)], "project_name string, contact_email string")
    assert rows(joins.generation_gate(asked, clients), "project_name", "allowed", "reason") == [
        ("a", True, None), ("b", False, "Client not ready for site generation"), ("c", False, "Client not found")]
    got = {r["project_name"]: r for r in joins.client_fallback(asked, clients).collect()}
    assert (got["a"]["client_id"], got["a"]["contact_email"]) == ("1", "m")
    assert got["b"]["contact_email"] is None and got["c"]["contact_email"] == "unknown@example.com"
    assert len(got["c"]["client_id"]) == 36


def test_new_clients_take_the_first_free_form(spark):
    forms = spark.createDataFrame([(2, "N2", "x", "e", "blog", "entry"), (1, "N1", "x", "e", "blog", "premium"), (3, "N3", "taken", "e", "blog", "entry")],
                                  "form_id int, client_name string, client_slug string, contact_email string, website_type string, tier string")
    taken = spark.createDataFrame([("taken",)], "client_slug string")
    assert rows(writers.new_clients(forms, taken, ["form_id"], NOW), "client_name", "builder_space_mode", "gcp_project_id") == [("N1", "DEDICATED", None)]


def test_archive_keeps_value_types_and_replaces_keys(spark):
    df = spark.createDataFrame([(1, "page", '{"n":1,"o":{"a":[1,2]},"__archived_at":"old"}'), (2, "client-page", "{}"), (3, "symbol", None), (None, "page", "{}")],
                               "id long, model string, data string").withColumn("space_id", F.lit("s"))
    got = {r["id"]: r["data"] for r in topk.archive_batch(df, NOW).collect()}
    import json
    assert set(got) == {1, 3}
    assert json.loads(got[1]) == {"n": 1, "o": {"a": [1, 2]}, "__archived_at": "2024-01-31T00:00:00", "__archived_for_deletion": True}
    assert json.loads(got[3]) == {"__archived_at": "2024-01-31T00:00:00", "__archived_for_deletion": True}


def test_archive_batch_is_per_space(spark):
    df = spark.range(600).select("id", F.lit("page").alias("model"), (F.col("id") % 2).alias("space_id"), F.lit("{}").alias("data"))
    assert rows(topk.archive_counts(topk.archive_batch(df, NOW)), "space_id", "archived_count") == [(0, 100), (1, 100)]


def test_a_request_sees_its_own_space_only(spark):
    entry = lambda i, space, model, slug: (i, space, model, '{"clientSlug":"%s","urlPath":"/p","env":"e"}' % slug)
    entries = spark.createDataFrame([entry(1, "own-a", "page", "a"), entry(2, "own-b", "page", "b"), entry(3, "s1", "client-page", "a"), entry(4, "s2", "client-page", "a")],
                                    "id long, space_id string, model string, data string")
    asked = spark.createDataFrame([(1, "a", "DEDICATED", "own-a", "/p", "e"), (2, "b", "DEDICATED", "own-b", "/p", "e"), (3, "a", "SHARED", "s2", "/p", "e"), (4, "z", "DEDICATED", "own-z", "/p", "e")],
                                  "request_id long, client_slug string, space_mode string, space_id string, url_path string, env string")
    models = {"SHARED": "client-page", "DEDICATED": "page"}
    for by_path in (True, False):
        got = tenancy.tenant_scope(asked, entries, models, by_path=by_path)
        assert rows(got, "request_id", "entry_id") == [(1, 1), (2, 2), (3, 4)]
        spaces = entries.select(F.col("id").alias("entry_id"), F.col("space_id").alias("entry_space"))
        assert got.join(spaces, "entry_id").join(asked, "request_id").where("entry_space <> space_id").count() == 0


def test_site_details_hold_every_row(spark):
    clients = spark.createDataFrame([("c", "slug", "N", "active", AT)], "id string, client_slug string, client_name string, status string, created_at timestamp_ntz")
    many = spark.range(30)
    deployments = many.select("id", F.lit("c").alias("client_id"), F.lit("sha").alias("commit_sha"), F.lit("ok").alias("status"), F.lit(AT).alias("deployed_at"))
    checks = many.select("id", F.lit("c").alias("client_id"), F.lit("down").alias("overall_status"), F.lit(AT).alias("checked_at"))
    log = many.select("id", F.lit("slug").alias("client_slug"), F.lit("t").alias("operation_type"), F.lit("s").alias("operation_status"), F.lit(AT).alias("started_at"))
    got = site_details(clients, deployments, checks, log).groupBy("kind").count()
    assert rows(got, "kind", "count") == [("deployment", 30), ("health_check", 30), ("operation", 30), ("site", 1)]


def test_env_diff_and_reconcile(spark):
    want = spark.createDataFrame([("p", "A", "1"), ("p", "B", None), ("p", "C", "3")], "project string, key string, value string")
    have = spark.createDataFrame([("e2", "p", "A"), ("e1", "p", "A"), ("e3", "p", "B")], "id string, project string, key string")
    assert rows(joins.env_diff(want, have), "key", "action", "existing_id") == [("A", "update", "e1"), ("B", "skip", None), ("C", "create", None)]
    schema = "platform string, resource_type string, resource_id string, resource_name string"
    seen = spark.createDataFrame([("g", "r", "1", "n1"), ("g", "r", "2", "n2")], schema)
    kept = spark.createDataFrame([("g", "r", "1", "m1", "c", AT), ("g", "r", "3", "m3", "c", AT)], schema + ", client_id string, last_verified_at timestamp_ntz")
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    assert rows(joins.inventory_reconcile(seen, kept, now), "resource_id", "state", "last_verified_at") == [
        ("1", "matched", datetime(2024, 3, 1)), ("2", "orphaned", datetime(2024, 3, 1)), ("3", "drift", AT)]


@pytest.mark.parametrize("results, want", [
    (['{"success":true}', '{"success":"true"}', None], (2, 0, "success")),
    (['{"success":true}', "{}", None], (1, 1, "partial_success")),
    (['{"success":null}', "{bad", None], (0, 2, "failed")),
    ([None, None, None], (0, 0, "in_progress")),
])
def test_operation_rollup(spark, results, want):
    df = spark.createDataFrame([tuple(results)], "a string, b string, c string")
    r = aggregates.operation_rollup(df, ["a", "b", "c"]).first()
    assert (r["success_count"], r["failure_count"], r["operation_status"]) == want


def test_metrics_of_null_and_single_times(spark):
    from decimal import Decimal

    data = [("a", Decimal("1.00"), True, 1, 2), ("a", Decimal("2.00"), False, 1, 2), ("a", None, True, 1, 2), ("b", Decimal("7.25"), True, 0, 0)]
    df = spark.createDataFrame(data, "k string, generation_time_seconds decimal(10,2), success boolean, components_generated long, files_generated long")
    got = {r["k"]: r for r in aggregates.generation_metrics(df, ["k"]).collect()}
    assert (got["a"]["runs"], got["a"]["succeeded"], got["a"]["mean_seconds"], round(got["a"]["p95_seconds"], 6)) == (3, 2, 1.5, 1.95)
    assert got["b"]["p95_seconds"] == 7.25
