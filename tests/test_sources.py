"""Reading exported listings, object metadata, messages and schemas."""

import json
import os
from datetime import datetime

from pyspark.sql import functions as F

from fleetspark.schemas import TABLES
from fleetspark.sources import messages, registry, snapshots, writers


def test_backup_objects_from_file_metadata(spark, tmp_path):
    for slug, name, size in [("a", "generation-1.zip", 3), ("a", "generation-2.zip", 5), ("b-c", "generation-1.zip", 7)]:
        folder = tmp_path / "projects" / slug
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"x" * size)
        os.utime(folder / name, (1_700_000_000 + size, 1_700_000_000 + size))
    (tmp_path / "projects" / "a" / "readme.txt").write_text("notes")
    (tmp_path / "projects" / "a" / "deep" / "projects").mkdir(parents=True)
    (tmp_path / "projects" / "a" / "deep" / "projects" / "x.tar").write_text("y")
    (tmp_path / "projects" / "b-c" / "empty.zip").write_text("")
    (tmp_path / "projects" / "stray.zip").write_text("below no slug")
    got = snapshots.backup_objects(spark, str(tmp_path))
    assert sorted((r["name"], r["client_slug"], r["size_bytes"]) for r in got.collect()) == [
        ("projects/a/deep/projects/x.tar", "a", 1), ("projects/a/generation-1.zip", "a", 3), ("projects/a/generation-2.zip", "a", 5), ("projects/a/readme.txt", "a", 5),
        ("projects/b-c/generation-1.zip", "b-c", 7)]
    assert got.filter("size_bytes = 3").first()["url"] == "gs://site-backups/projects/a/generation-1.zip"
    assert got.filter("size_bytes = 3").first()["created_at"] == datetime(2023, 11, 14, 22, 13, 23)


def test_exported_backup_listing_keeps_empty_objects(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"name": "projects/a/x.zip", "size_bytes": 0, "url": "gs://b/projects/a/x.zip"}) + "\n")
    row = snapshots.exported_objects(spark, str(tmp_path)).first()
    assert (row["name"], row["client_slug"], row["size_bytes"], row["url"], row["updated_at"]) == ("projects/a/x.zip", "a", 0, "gs://b/projects/a/x.zip", None)


def test_snapshots(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.json").write_text(json.dumps({"name": "a", "private": True, "created_at": "2024-01-01T00:00:00", "size": 4, "extra": 1}) + "\n")
    row = snapshots.repo_snapshot(spark, str(tmp_path / "r")).first()
    assert (row["name"], row["private"], row["archived"], row["created_at"], row["size"]) == ("a", True, None, datetime(2024, 1, 1), 4)
    projects = spark.createDataFrame([("p1", "one", "nextjs")], "id string, name string, framework string")
    asked = spark.createDataFrame([("p1",), ("one",), ("zzz",)], "project_id string")
    got = sorted((r["project_id"], r["name"], r["error"]) for r in snapshots.project_details(projects, asked).collect())
    assert got == [("one", "one", None), ("p1", "one", None), ("zzz", None, "Project not found: zzz")]


def test_messages_round_trip(spark):
    forms = spark.createDataFrame([("A", "a", "e@x.co", None, "entry", "pub-1", "k"), ("B", "b", "e@x.co", "blog", "premium", "pub-1", "k")],
                                  "client_name string, client_slug string, contact_email string, website_type string, tier string, builder_public_key string, builder_private_key string")
    sent = messages.onboarding_messages(forms, F.concat(F.lit("m"), F.col("client_slug")), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    texts = {r["clientId"]: json.loads(r["value"]) for r in sent.collect()}
    assert "builder" not in texts["ma"] and texts["ma"]["websiteType"] == "marketing"
    assert texts["mb"]["builder"] == {"publicKey": "pub-1", "privateKey": "k", "spaceId": ""}
    back = messages.parse_messages(sent.select("value")).collect()
    assert {r["clientSlug"] for r in back} == {"a", "b"} and all(r["rejected"] is None for r in back)


def test_bad_messages_are_rejected(spark):
    bad = ["{broken", '{"clientId":"x"}', "[]", ""]
    df = messages.parse_messages(spark.createDataFrame([(b,) for b in bad], "value string"))
    assert sorted(r["rejected"] for r in df.collect()) == sorted(bad)
    assert df.filter("clientId is not null").count() == 0


def test_every_table_scans_with_its_schema(spark, tmp_path):
    for name in TABLES:
        empty = spark.createDataFrame([], registry.table_schema(name))
        registry.write_table(empty.drop(empty.columns[-1]), str(tmp_path), name)
        assert registry.scan_table(spark, str(tmp_path), name).schema.fieldNames() == registry.table_schema(name).fieldNames()


def test_schema_diff(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, b string")
    got = {r["column_name"]: (r["state"], r["null_count"]) for r in registry.schema_diff(df, spark.createDataFrame([], "id bigint, b string, c string").schema).collect()}
    assert got == {"id": ("type_differs", 0), "b": ("ok", 1), "c": ("missing", None)}


def test_generation_log_rounds(spark, tmp_path):
    df = spark.createDataFrame([("p", "i", 1.25, True), ("q", "i", 2.346, False)], "project_name string, industry string, generation_time_seconds double, success boolean")
    for _ in range(2):
        writers.append_generation_log(df, str(tmp_path / "log"))
    got = spark.read.parquet(str(tmp_path / "log"))
    assert got.count() == 4 and len(got.columns) == 11
    assert sorted({str(r["generation_time_seconds"]) for r in got.collect()}) == ["1.25", "2.35"]


def test_backups_are_partitioned_and_appended(spark, tmp_path):
    files = spark.createDataFrame([("p", "a.ts", "1"), ("p", "b.ts", "22"), ("q", "a.ts", "3")], "project_name string, path string, content string")
    for at in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        writers.write_backups(files, str(tmp_path / "b"), at)
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.filter("project_name = 'p' and generation_ts = '20240101-000000'").count() == 2 and back.count() == 6
    meta = {r["project_name"]: (r["name"], r["files"], r["bytes"]) for r in writers.backup_metadata(files, "2024-01-01 00:00:00").collect()}
    assert meta["p"] == ("projects/p/generation-20240101-000000.zip", 2, 3)
