"""Plans for keys that hold a large part of all rows give the plain result."""

import collections
import random

from pyspark.sql import functions as F

from fleetspark.operators.lifecycle import apply_space_deltas
from fleetspark.plans.hot_keys import hot_groups, left_join_groups


def _resources(spark):
    rows = [("big", "gcs", f"g{i}") for i in range(500)] + [("big", "github", f"h{i}") for i in range(3)]
    rows += [("wide", "github", f"w{i}") for i in range(120)] + [("small", "gcs", "s1"), ("small", "github", "s2"), ("small", "github", "s3")]
    rows += [(None, "gcs", f"n{i}") for i in range(400)] + [("stranger", "gcs", f"x{i}") for i in range(200)]
    return rows, spark.createDataFrame(rows, "owner string, platform string, rid string")


def test_hot_left_joins_equal_plain_left_joins(spark):
    rows, facts = _resources(spark)
    clients = spark.createDataFrame([("big",), ("wide",), ("small",), ("none",)], "id string")
    picks = {"github": [F.col("rid").alias("gh")], "gcs": [F.col("rid").alias("gc")], "vercel": [F.col("rid").alias("ve")]}
    assert {r["owner"]: r["_widest"] for r in hot_groups(facts, "owner", "platform", 100).collect()} == {
        "big": "gcs", "wide": "github", "stranger": "gcs"}
    got = left_join_groups(clients, "id", facts, "owner", "platform", picks, "rid", hot_rows=100).collect()
    by = collections.defaultdict(list)
    for owner, platform, rid in rows:
        by[owner, platform].append(rid)
    want = collections.Counter(
        (c, g, b, v)
        for c in ["big", "wide", "small", "none"]
        for g in by[c, "github"] or [None] for b in by[c, "gcs"] or [None] for v in by[c, "vercel"] or [None]
    )
    assert collections.Counter((r["id"], r["gh"], r["gc"], r["ve"]) for r in got) == want


def test_hot_rows_are_spread_and_nothing_is_broadcast_but_the_hot_list(spark):
    _, facts = _resources(spark)
    clients = spark.createDataFrame([("big",), ("small",)], "id string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = left_join_groups(clients, "id", facts, "owner", "platform", {"gcs": [F.col("rid")]}, "rid", 100)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "_slice" in plan[plan.index("SortMergeJoin"):][:200]
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 501 and max(sizes) < 250
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_space_deltas_fold_like_a_loop(spark):
    rng = random.Random(5)
    changes = [(0 if rng.random() < 0.7 else rng.randrange(1, 6), rng.randrange(200), i, rng.choice([-3, -2, -1, 1, 2])) for i in range(4000)]
    spaces = [(i, f"space{i}", 4 if i != 3 else None, None) for i in range(8)]
    df = apply_space_deltas(
        spark.createDataFrame(spaces, "id int, space_name string, active_clients int, updated_at timestamp_ntz"),
        spark.createDataFrame(changes, "space_id int, requested_at long, id long, delta int").repartition(5),
        as_of="2024-01-31 00:00:00", partitions=13,
    )
    want = {}
    for i, _, n, _ in spaces:
        mine = sorted(c for c in changes if c[0] == i)
        value = n
        for _, _, _, delta in mine:
            value = 0 if value is None else max(0, value + delta)  # GREATEST(0, NULL) is 0
        want[i] = value
    assert {r["id"]: r["active_clients"] for r in df.collect()} == want
