"""Tables laid out by client: no shuffle of the facts, hot clients beside the buckets."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from fleetspark.catalog.tables import AS_OF
from fleetspark.plans import views
from fleetspark.session import work_dir
from fleetspark.sources import layout
from fleetspark.sources.registry import conform

NAMES = ("clients", "platform_inventory", "site_deployments", "site_health_checks")


@pytest.fixture(scope="module")
def written(spark, tables):
    prefix = f"laid_{uuid.uuid4().hex}"
    out = layout.ClusteredTables(spark, work_dir(spark, "layout"), prefix)
    out.write({n: conform(getattr(tables, n), n) for n in NAMES}, 4, hot_rows=12)
    return out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_views_by_client_shuffle_nothing(written, no_broadcast):
    inventory = views.client_full_inventory(*[written.bucketed(n) for n in NAMES], hot_rows=None)
    health = views.health_summary(written.bucketed("clients"), written.bucketed("site_health_checks"), AS_OF, ordered=False)
    for df in (inventory, health):
        text = plan(df)
        assert "Exchange" not in text and "SortMergeJoin" in text
        assert re.search(r"SelectedBucketsCount: 4 out of 4", text)


def test_hot_clients_and_rows_without_client_lie_beside(written, tables):
    hot = {r[0] for r in written.hot("site_health_checks").select("client_id").distinct().collect()}
    counts = {r[0]: max(r[1], 0) for r in tables.site_health_checks.groupBy("client_id").count().collect()}
    assert hot and all(c in hot for c, n in counts.items() if n > 12 and c)
    assert written.bucketed("platform_inventory").where("client_id IS NULL").isEmpty() and not written.hot("platform_inventory").where("client_id IS NULL").isEmpty()
    # A client is hot in all tables or in none.
    cold = {r[0] for r in written.bucketed("site_deployments").select("client_id").distinct().collect()}
    assert not cold & hot
    for n in NAMES:
        assert written.read(n).count() == getattr(tables, n).count()


def test_views_are_the_same_rows(written, tables):
    given = [conform(getattr(tables, n), n) for n in NAMES]
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(layout.clustered_inventory(written)) == plain(views.client_full_inventory(*given))
    assert plain(layout.clustered_health_summary(written, AS_OF)) == plain(views.health_summary(given[0], given[3], AS_OF, ordered=False))


def test_attach_knows_the_buckets_again(spark, written, no_broadcast):
    other = layout.ClusteredTables(spark, written.root, f"again_{uuid.uuid4().hex}")
    other.attach()
    assert other.read("clients").count() == written.read("clients").count()
    joined = other.bucketed("site_deployments").join(other.bucketed("clients").withColumnRenamed("id", "owner"), F.col("client_id") == F.col("owner"))
    assert "Exchange" not in plan(joined)


def test_one_file_per_bucket(written):
    files = [f for f in written.folder.names("site_deployments/buckets") if f.endswith(".parquet")]
    assert 1 <= len(files) <= 4


def test_empty_tables(spark, tables):
    out = layout.ClusteredTables(spark, work_dir(spark, "layout"), f"empty_{uuid.uuid4().hex}")
    out.write({n: conform(getattr(tables, n).limit(0), n) for n in NAMES}, 2)
    assert layout.clustered_inventory(out).collect() == []
