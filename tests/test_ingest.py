"""JSON keys as columns: pushed to the files, read instead of the text, the same answers."""

import re

import pytest
from pyspark.sql import functions as F

from fleetspark.functions.records import json_key, json_value
from fleetspark.operators import aggregates, filters, joins
from fleetspark.plans import views
from fleetspark.session import work_dir
from fleetspark.sources import ingest
from fleetspark.sources.registry import conform


@pytest.fixture(scope="module")
def stored(spark, tables):
    root = work_dir(spark, "ingested")
    for name, cluster in (("deleted_sites", ("client_data__client_slug",)), ("platform_inventory", ()), ("registry_operations_log", ())):
        ingest.write_ingested(getattr(tables, name), root, name, cluster=cluster)
    return lambda name: ingest.scan_ingested(spark, root, name)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text):
    return [set(re.findall(r"(\w+):", found)) for found in re.findall(r"ReadSchema: struct<(.*?)>(?:\s|$)", text)]


def rows(df):
    return sorted(map(str, df.collect()))


def test_filters_on_keys_reach_the_files(stored):
    found = filters.json_key_filter(stored("deleted_sites"), "client_data", "client_slug", "client-7").select("id")
    text = plan(found)
    assert "EqualTo(client_data__client_slug,client-7)" in text and "get_json_object" not in text
    assert read_columns(text) == [{"id", "client_data__client_slug"}]
    inventory = stored("platform_inventory")
    text = plan(inventory.where(json_value(inventory, "resource_metadata", "backup_count", "bigint") >= 10).select("id"))
    assert "GreaterThanOrEqual(resource_metadata__backup_count,10)" in text


def test_views_read_no_json_text(stored, tables):
    found = joins.deleted_slugs(stored("deleted_sites"))
    assert read_columns(plan(found)) == [{"client_data__client_slug"}]
    given = aggregates.operation_rollup(conform(tables.registry_operations_log, "registry_operations_log"))
    rollup = aggregates.operation_rollup(stored("registry_operations_log"))
    assert rows(rollup.select(given.columns)) == rows(given)


def test_same_answers_as_from_the_text(stored, tables):
    given = conform(tables.platform_inventory, "platform_inventory")
    view = lambda inventory: views.client_full_inventory(tables.clients, inventory, tables.site_deployments, tables.site_health_checks)
    assert rows(view(stored("platform_inventory"))) == rows(view(given))
    assert rows(joins.deleted_slugs(stored("deleted_sites"))) == rows(joins.deleted_slugs(tables.deleted_sites))


ODD = [(1, '{"a": "x", "n": 7}'), (2, '{"a": null, "n": "7"}'), (3, "{broken"), (4, None), (5, '{"n": "seven"}'), (6, '{"a": {"b": 1}, "n": 1e30}'), (7, "[]"), (8, '{"a": "x", "a": "y"}')]


def test_odd_texts(spark):
    df = spark.createDataFrame(ODD, "id int, doc string")
    out = ingest.extracted(df, {"doc": {"a": "string", "n": "bigint"}})
    assert out.columns == ["id", "doc", "doc__a", "doc__n"]
    plain = df.select("id", json_key(df, "doc", "a").alias("a"), json_value(df, "doc", "n", "bigint").alias("n"))
    stored = out.select("id", json_key(out, "doc", "a").alias("a"), json_value(out, "doc", "n", "bigint").alias("n"))
    assert rows(plain) == rows(stored)
    assert {r["id"]: r["doc__n"] for r in out.collect()} == {1: 7, 2: 7, 3: None, 4: None, 5: None, 6: None, 7: None, 8: None}


def test_text_of_a_typed_key_is_read_from_the_json(spark):
    df = ingest.extracted(spark.createDataFrame([(1, '{"n": "7.50"}')], "id int, doc string"), {"doc": {"n": "double"}})
    assert df.select(json_key(df, "doc", "n")).first()[0] == "7.50" and df.first()["doc__n"] == 7.5


def test_stale_rows(spark, tables, stored):
    sites = stored("deleted_sites")
    assert ingest.stale_rows(sites, "deleted_sites").isEmpty()
    wrong = sites.withColumn("client_data__client_slug", F.when(F.col("id") == sites.first()["id"], "other").otherwise(F.col("client_data__client_slug")))
    assert ingest.stale_rows(wrong, "deleted_sites").select("id").collect() == [(sites.first()["id"],)]


def test_extracting_again_replaces(spark):
    keys = {"doc": {"a": "string"}}
    once = ingest.extracted(spark.createDataFrame(ODD, "id int, doc string"), keys)
    assert rows(ingest.extracted(once, keys)) == rows(once)
