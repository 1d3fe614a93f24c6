"""Writing with the rules: parts, reasons, observed counts, one scan; metrics that add up."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fleetspark.operators import sketches
from fleetspark.schemas import TABLES
from fleetspark.session import work_dir
from fleetspark.sources import checked
from fleetspark.sources.registry import conform
from fleetspark.sources.versions import VersionStore


def clients(spark, *rows):
    full = [dict(zip(("id", "client_slug", "health_status"), r)) for r in rows]
    df = spark.createDataFrame([(r["id"], r["client_slug"], r["health_status"]) for r in full], "id string, client_slug string, health_status string")
    for c in ("client_name", "contact_email", "website_type", "status"):
        df = df.withColumn(c, F.lit("x"))
    return conform(df, "clients")


def parts(done):
    return sorted(r["id"] for r in done.good().collect()), {r["id"]: sorted(r[checked.RULES]) for r in done.rejected().collect()}


def test_good_and_broken_rows(spark, tmp_path):
    df = clients(spark, ("1", "a", "healthy"), ("2", "b", "sick"), ("3", None, None), ("4", None, "sick"))
    done = checked.write_checked(df, str(tmp_path), "clients")
    assert parts(done) == (["1"], {"2": ["check_health_status"], "3": ["not_null_client_slug"], "4": ["check_health_status", "not_null_client_slug"]})
    assert done.good().columns == [c.split(" ")[0] for c in TABLES["clients"].split(", ")]
    assert {k: v for k, v in done.counts.items() if v} == {"rows": 4, "good": 1, "check_health_status": 2, "not_null_client_slug": 2}


def test_unique_keys(spark, tmp_path):
    stored = clients(spark, ("9", "taken", "healthy"), ("8", None, "healthy"))
    same = [("5", "twin", "healthy")] * 3
    df = clients(spark, ("1", "a", "healthy"), ("2", "taken", "healthy"), ("3", "a", "healthy"), *same, ("6", None, "healthy"), ("7", None, "healthy"))
    done = checked.write_checked(df.repartition(5), str(tmp_path), "clients", {"clients": stored})
    good, broken = parts(done)
    assert good in (["1", "5"], ["3", "5"]) and done.counts["unique_client_slug"] == 4 and done.counts["rows"] == 8
    assert broken["2"] == ["unique_client_slug"] and done.rejected().where("id = '5'").count() == 2


def test_foreign_keys(spark, tmp_path):
    rows = spark.createDataFrame([("1", "c1"), ("2", "lost"), ("3", None)], "id string, client_id string")
    df = rows.withColumns({"overall_status": F.lit("healthy")})
    done = checked.write_checked(df, str(tmp_path), "site_health_checks", {"clients": clients(spark, ("c1", "a", None), ("c1", "b", None))})
    assert parts(done) == (["1", "3"], {"2": ["foreign_key_client_id"]})


@pytest.mark.parametrize("rows", [[], [("1", "a", "healthy")], [("1", "a", "sick")]])
def test_parts_without_rows(spark, tmp_path, rows):
    df = clients(spark, *rows)
    done = checked.write_checked(df, str(tmp_path), "clients")
    assert done.good().count() + done.rejected().count() == len(rows) == done.counts["rows"]


def test_the_table_is_read_once(spark, tables, tmp_path):
    conform(tables.site_deployments, "site_deployments").write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in")).withColumn("status", F.when(F.rand(5) < 0.2, "odd").otherwise(F.col("status")))
    done = checked.write_checked(df, str(tmp_path / "out"), "site_deployments", {"clients": tables.clients})
    # A random status was drawn once per row: both parts and the counts agree.
    assert done.good().count() == done.counts["good"] and done.rejected().count() == done.counts["rows"] - done.counts["good"]
    assert done.rejected().where(F.array_contains(checked.RULES, "check_deployment_status")).count() == done.counts["check_deployment_status"] > 0


def runs(spark, n):
    df = spark.range(n).select(
        F.col("id"), (F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(F.col("id") % 20)).alias("created_at"),
        F.when(F.col("id") % 3 == 0, "saas").otherwise("shop").alias("industry"),
        F.when(F.col("id") % 50 != 7, F.round(F.pow(F.rand(3), 4) * 500, 2)).cast("decimal(10,2)").alias("generation_time_seconds"),
        (F.col("id") % 4 > 0).alias("success"), F.lit(2).alias("components_generated"), F.lit(5).alias("files_generated"))
    return df.persist()


def test_merged_parts_are_as_good_as_the_whole(spark):
    df = runs(spark, 60_000)
    by_day = sketches.daily_metrics(df, ["industry"])
    assert by_day.count() == 40
    whole = sketches.rolled_up(sketches.daily_metrics(df.withColumn("created_at", F.lit(None).cast("timestamp_ntz")), ["industry"]), ["industry"])
    for rolled in (sketches.rolled_up(by_day, ["industry"], {"p95_seconds": 0.95, "median": 0.5}), whole):
        for name, fraction in (("p95_seconds", 0.95), ("median", 0.5)):
            if name in rolled.columns:
                errors = [r["rank_error"] for r in sketches.rank_errors(df, rolled, ["industry"], name, fraction).collect()]
                assert len(errors) == 2 and max(errors) <= sketches.rank_error()
    # Some days only.
    week = by_day.where(F.col("day") < date(2024, 1, 8))
    exact = df.where(F.col("created_at") < datetime(2024, 1, 8))
    rolled = sketches.rolled_up(week, ["industry"])
    assert {r["industry"]: r["runs"] for r in rolled.collect()} == {r["industry"]: r["count"] for r in exact.groupBy("industry").count().collect()}
    assert max(r["rank_error"] for r in sketches.rank_errors(exact, rolled, ["industry"], "p95_seconds", 0.95).collect()) <= sketches.rank_error()


def test_a_sketch_does_not_grow(spark):
    sizes = [sketches.daily_metrics(runs(spark, n), []).agg(F.max(F.octet_length("sketch"))).first()[0] for n in (20_000, 200_000)]
    assert sizes[1] < 16_000 and sizes[1] < 2 * sizes[0]


def test_key_without_times(spark):
    df = runs(spark, 100).withColumn("generation_time_seconds", F.lit(None).cast("decimal(10,2)"))
    assert {r["p95_seconds"] for r in sketches.rolled_up(sketches.daily_metrics(df, ["industry"]), ["industry"]).collect()} == {None}


def test_refreshed_days(spark):
    store, df = VersionStore(spark, work_dir(spark, "daily")), runs(spark, 400)
    day = F.to_date("created_at").alias("day")
    sketches.refresh_days(store, df.where("id < 200"), df.select(day), ["industry"])
    sketches.refresh_days(store, df, df.where("id % 20 = 3").select(day), ["industry"])
    got = {r["day"]: r["n"] for r in store.read("daily_metrics").groupBy("day").agg(F.sum("runs").alias("n")).collect()}
    assert got[date(2024, 1, 4)] == 20 and got[date(2024, 1, 1)] == 10 and len(got) == 20
