"""Versions of tables: several frames at once, failed and conflicting changes, files carried over."""

import json

import pytest
from pyspark.sql import functions as F

from fleetspark.operators import commits
from fleetspark.session import work_dir
from fleetspark.sources.shared_files import SharedFolder
from fleetspark.sources.versions import CommitConflict, VersionStore, commit


@pytest.fixture
def store(spark):
    return VersionStore(spark, work_dir(spark, "store"))


def numbers(spark, n, shift=0):
    return spark.range(n).select(F.col("id"), (F.col("id") + shift).alias("x"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_every_version_stays_readable(spark, store):
    assert store.latest() == 0 and store.versions() == []
    assert commit(store, {"a": numbers(spark, 10), "b": numbers(spark, 3)}) == 1
    assert commit(store, {"a": numbers(spark, 5, 100)}) == 2
    assert store.versions() == [1, 2]
    assert rows(store.read("a", 1)) == [(i, i) for i in range(10)]
    assert rows(store.read("a")) == [(i, i + 100) for i in range(5)]
    # A table that a change does not touch is the same files.
    assert store.files("b", 1) == store.files("b", 2) and rows(store.read("b")) == [(i, i) for i in range(3)]
    with pytest.raises(KeyError):
        store.read("c")


def test_a_failed_second_frame_shows_nothing(spark, store):
    commit(store, {"a": numbers(spark, 10), "b": numbers(spark, 3)})
    change = store.begin()
    change.replace("a", numbers(spark, 1, 7))
    broken = numbers(spark, 3).withColumn("x", F.when(F.col("id") == 2, F.raise_error(F.lit("broken row"))).otherwise(F.col("x")).cast("long"))
    with pytest.raises(Exception, match="broken row"):
        change.replace("b", broken)
    assert store.latest() == 1 and len(rows(store.read("a"))) == 10 and len(rows(store.read("b"))) == 3
    # What the failed change wrote is known and in no version.
    left = store.unreferenced()
    assert any(p.startswith("a/") for p in left) and not {f"a/{f.split('/')[0]}" for f in store.files("a")} & set(left)
    assert commit(store, {"b": numbers(spark, 4)}) == 2


def test_the_second_of_two_changes_conflicts(spark, store):
    commit(store, {"a": numbers(spark, 4)})
    first, second = store.begin(), store.begin()
    first.append("a", numbers(spark, 1, 50))
    second.append("a", numbers(spark, 1, 90))
    assert first.commit() == 2
    with pytest.raises(CommitConflict):
        second.commit()
    assert rows(store.read("a")) == sorted([(i, i) for i in range(4)] + [(0, 50)])


def test_rewrite_touches_only_files_with_a_hit(spark, store):
    change = store.begin()
    change.replace("a", numbers(spark, 1000), ("id",), 6)
    change.commit()
    before = store.files("a")
    assert len(before) > 3
    change = store.begin()
    gone = change.rewrite("a", F.col("id") == 500, lambda part: part.where("id <> 500"))
    keys = spark.createDataFrame([(1,), (2,), (2,), (5000,)], "id long")
    moved = change.rewrite("a", keys, lambda part: part.withColumn("x", F.when(F.col("id").isin(1, 2), -1).otherwise(F.col("x"))))
    change.commit()
    after = store.files("a")
    assert len(gone) == 1 and len(moved) == 1 and set(before) - set(after) == {*gone, *moved}
    assert rows(store.read("a")) == [(i, -1 if i in (1, 2) else i) for i in range(1000) if i != 500]
    assert rows(store.read("a", 1)) == [(i, i) for i in range(1000)]


def test_no_hit_rewrites_nothing(spark, store):
    commit(store, {"a": numbers(spark, 10)})
    change = store.begin()
    assert change.rewrite("a", F.col("id") > 99, lambda part: part.limit(0)) == []
    assert change.rewrite("nothing", F.lit(True), lambda part: part) == []
    change.commit()
    assert store.files("a", 1) == store.files("a", 2)


def test_appended_columns_are_null_before(spark, store):
    commit(store, {"a": numbers(spark, 2)})
    change = store.begin()
    change.append("a", spark.createDataFrame([(9, "new")], "id long, note string"))
    change.commit()
    assert sorted(map(tuple, store.read("a").collect()), key=str) == [(0, 0, None), (1, 1, None), (9, None, "new")]
    with pytest.raises(ValueError, match="a.id is bigint, not string"):
        store.begin().append("a", spark.createDataFrame([("9",)], "id string"))


def test_empty_tables(spark, store):
    commit(store, {"a": numbers(spark, 0)})
    assert rows(store.read("a")) == [] and store.read("a").columns == ["id", "x"]
    change = store.begin()
    change.rewrite("a", F.lit(True), lambda part: part)
    change.drop("a")
    change.commit()
    assert store.lists() == {} and store.lists(1) != {}


def test_a_change_reads_its_own_work(spark, store):
    commit(store, {"a": numbers(spark, 4)})
    change = store.begin()
    change.append("a", numbers(spark, 1, 50))
    change.rewrite("a", F.col("x") == 50, lambda part: part.withColumn("x", F.lit(51).cast("long")))
    assert (0, 51) in rows(change.read("a")) and (0, 51) not in rows(store.read("a"))


def test_publish_is_once(spark):
    folder = SharedFolder(spark, work_dir(spark, "small-files"))
    assert folder.names("x") == [] and not folder.exists("x/1.json")
    assert folder.publish("x/1.json", json.dumps({"é": 1})) and not folder.publish("x/1.json", "{}")
    assert json.loads(folder.read("x/1.json")) == {"é": 1}
    assert folder.publish("x/1.json", "{}", replace=True) and folder.read("x/1.json") == "{}"
    assert folder.names("x") == ["1.json"]


def test_cascade_leaves_files_without_deleted_clients(spark, tables, store):
    names = ["site_deployments", "site_health_checks", "platform_inventory", "registry_operations_log"]
    commits.publish_registry(store, {n: getattr(tables, n) for n in names}, 6)
    one = tables.site_deployments.select("client_id").orderBy("client_id").limit(1)
    version, replaced = commits.commit_cascade(store, one, names[:2], names[2:])
    for name in names:
        old, new = store.files(name, 1), store.files(name, version)
        assert len(replaced[name]) < len(old) and set(old) - set(new) == set(replaced[name])
    gone = one.first()[0]
    assert store.read("site_deployments").where(F.col("client_id") == gone).isEmpty()
    assert store.read("platform_inventory").count() == tables.platform_inventory.count()
    # The files are found by their keys alone.
    plan = store.read("site_deployments").select("client_id", "_metadata.file_path")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<client_id:string>" in plan


def test_used_tokens_touch_their_files(spark, tables, store):
    commits.publish_registry(store, {"onboarding_tokens": tables.onboarding_tokens}, 6)
    token = tables.onboarding_tokens.where("NOT used").select("token").limit(1)
    version, replaced = commits.commit_used_tokens(store, token)
    assert len(replaced) == 1 and set(store.files("onboarding_tokens", 1)) - set(store.files("onboarding_tokens", version)) == set(replaced)
    assert store.read("onboarding_tokens").where(F.col("token") == token.first()[0]).first()["used"]


def test_files_grow_with_the_rows(spark, tables, store):
    deployments = tables.site_deployments
    n = deployments.count()
    commits.publish_registry(store, {"site_deployments": deployments}, 2, file_rows=n // 5)
    assert len(store.files("site_deployments")) == -(-n // (n // 5)) > 2 and store.read("site_deployments").count() == n


def test_one_key_lies_in_several_files(spark, store):
    change = store.begin()
    change.replace("a", spark.range(8000).select("id", F.when(F.col("id") % 8 == 0, F.col("id")).alias("owner")), ("owner",), 8)
    change.commit()

    def largest():
        return store.read("a").groupBy(F.col("_metadata.file_path")).count().agg(F.max("count")).first()[0]

    # 7,000 of the rows have no owner.
    assert largest() < 3000
    change = store.begin()
    assert len(change.rewrite("a", F.lit(True), lambda part: part.withColumn("owner", F.lit(None).cast("long")))) == 8
    change.commit()
    assert largest() < 3000 and store.read("a").select(F.sum("id")).first()[0] == 8000 * 7999 // 2
