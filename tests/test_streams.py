"""Streams over several batches: late rows, redelivery, timers, repeated upserts."""

import itertools
import json
from datetime import datetime, timedelta

from fleetspark.session import work_dir
from fleetspark.streaming import builds, flows
from fleetspark.streaming import run


def run_to_table(stream, name):
    return run.run_to_table(stream, work_dir(stream.sparkSession, name), 4)

START = datetime(2024, 1, 1)
_n = itertools.count()


def feed(spark, tmp_path, schema, *batches):
    """A stream that reads one batch after the other."""
    folder = tmp_path / f"in{next(_n)}"
    for i, rows in enumerate(batches):
        target = str(folder / f"b{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.json(target)
    import os
    for i, _ in enumerate(batches):
        for part in sorted((folder / f"b{i}").glob("part-*")):
            os.utime(part, (1_700_000_000 + i * 10,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder / "b*"))


def at(seconds):
    return START + timedelta(seconds=seconds)


def message(i, **more):
    return json.dumps({"clientId": f"m{i}", "clientSlug": f"s{i}", "tier": "entry", **more})


def test_redelivered_and_broken_messages_are_dropped(spark, tmp_path):
    stream = feed(spark, tmp_path, "value string, received_at timestamp",
                  [(message(1), at(0)), ("{broken", at(1))], [(message(1), at(60)), (message(2), at(61))], [(message(2, tier="x"), at(62))])
    got = run_to_table(flows.onboarding_queue(stream), "queue-test").collect()
    assert sorted(r["clientSlug"] for r in got) == ["s1", "s2"]


def test_windows_drop_late_rows(spark, tmp_path):
    hour = 3600
    stream = feed(spark, tmp_path, "checked_at timestamp, overall_status string",
                  [(at(10), "down"), (at(20), "down")], [(at(5 * hour), "healthy")], [(at(5 * hour + 60), "healthy")],
                  [(at(30), "down")], [(at(9 * hour), "healthy")])
    got = run_to_table(flows.health_windows(stream), "windows-test").collect()
    assert sorted((r["window_start"], r["overall_status"], r["checks"]) for r in got) == [(at(0), "down", 2), (at(5 * hour), "healthy", 2)]


def test_operations_are_paired_across_batches(spark, tmp_path):
    log = feed(spark, tmp_path, "id long, started_at timestamp, completed_at timestamp",
               [(1, at(0), None), (2, at(5), None)], [(1, None, at(90))], [(2, None, at(5 + 7200))])
    started = log.filter("started_at is not null").select("id", "started_at")
    completed = log.filter("completed_at is not null").select("id", "completed_at")
    got = run_to_table(flows.operation_pairing(started, completed), "pairs-test").collect()
    assert [(r["operation_id"], r["duration_ms"]) for r in got] == [(1, 90_000)]


def test_builds_end_by_state_or_time_out(spark, tmp_path):
    stream = feed(
        spark, tmp_path, "deployment_id long, polled_at timestamp, ready_state string",
        [(1, at(0), "BUILDING"), (2, at(0), "QUEUED"), (3, at(0), "BUILDING"), (4, at(0), "ERROR")],
        [(1, at(200), "READY"), (2, at(301), "READY"), (4, at(10), "READY")],
        [(9, at(4000), "BUILDING")],
        [(9, at(4100), "CANCELED"), (1, at(4100), "ERROR")],
    )
    got = run_to_table(builds.build_timeout(stream), "builds-test").collect()
    assert sorted((r["deployment_id"], r["state"], r["success"], (r["ended_at"] - START).total_seconds()) for r in got) == [
        (1, "READY", True, 200.0), (2, "TIMEOUT", False, 300.0), (3, "TIMEOUT", False, 300.0), (4, "ERROR", False, 0.0), (9, "CANCELED", False, 4100.0)]


CHECK = ("id string, client_id string, checked_at timestamp, overall_status string, github_status string, vercel_status string, "
         "builder_status string, gcs_status string, staging_url_status string")


def check(i, client, t, s):
    return (f"hc-{i}", client, t, s, "h", "h", "h", "h", "h")


def test_latest_health_over_batches_and_restarts(spark, tmp_path):
    batches = [[check(1, "a", at(5), "down"), check(2, "a", at(9), "healthy"), check(3, "b", at(1), "down")],
               [check(4, "a", at(7), "down"), check(5, "b", at(2), "degraded")], [check(6, "b", None, "error"), check(7, "c", at(1), "down")]]
    root = str(tmp_path / "health")
    want = [("a", "hc-2", "healthy"), ("b", "hc-6", "error"), ("c", "hc-7", "down")]
    stream = feed(spark, tmp_path, CHECK, *batches)
    for _ in range(2):  # the second run starts again without new input
        got = run.latest_health_stream(stream, root, 4).collect()
        assert sorted((r["client_id"], r["id"], r["overall_status"]) for r in got) == want
    # A batch writes the clients it changed, not all.
    changed = {r["batch"]: r["n"] for r in spark.read.parquet(f"{root}/state/log/*").groupBy("batch").agg({"client_id": "count"}).toDF("batch", "n").collect()}
    assert changed[0] == 2 and changed[2] == 2


def test_latest_health_of_no_rows(spark, tmp_path):
    state = run.HealthState(spark, str(tmp_path / "none"), flows.newest_checks(spark.createDataFrame([], CHECK)).schema)
    assert state.current().collect() == []
    state.upsert(flows.newest_checks(spark.createDataFrame([check(1, "a", at(1), "down")], CHECK)), 0)
    for _ in range(2):  # a batch may be run again after a failure
        state.upsert(flows.newest_checks(spark.createDataFrame([check(2, "a", at(2), "healthy")], CHECK)), 1)
    assert [r["id"] for r in state.current().collect()] == ["hc-2"]


def upserts(spark, state, ids):
    for i in ids:
        state.upsert(flows.newest_checks(spark.createDataFrame([check(i, f"c{i % 7}", at(i), "down")], CHECK)), i)


def held(state):
    return {r["client_id"]: r["id"] for r in state.current().collect()}


def health_state(spark, tmp_path, every):
    return run.HealthState(spark, str(tmp_path / "health-state"), flows.newest_checks(spark.createDataFrame([], CHECK)).schema, every)


def test_health_state_stays_small(spark, tmp_path):
    """A hundred batches leave two bases and the log since the older one."""
    state = health_state(spark, tmp_path, 8)
    upserts(spark, state, range(100))
    assert held(state) == {f"c{c}": f"hc-{max(i for i in range(100) if i % 7 == c)}" for c in range(7)}
    assert state.bases() == [95, 87] and len(state.folder.names("base")) == 2 and len(state.folder.names("log")) <= 16
    # A stream that starts again repeats its last batches.
    before = held(state)
    upserts(spark, state, (94, 95, 99))
    assert held(state) == before and state.bases() == [95, 87]


def test_health_state_survives_a_crash_while_compacting(spark, tmp_path, monkeypatch):
    state = health_state(spark, tmp_path, 4)
    upserts(spark, state, range(6))
    before = held(state)
    with monkeypatch.context() as broken:
        # The base is written, but nothing names it.
        broken.setattr(state.folder, "publish", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        try:
            state.compact(5)
        except OSError:
            pass
    assert state.folder.exists("base/000000000005") and state.bases() == [3] and held(state) == before
    # Named, but the old parts are still there.
    with monkeypatch.context() as broken:
        broken.setattr(state.folder, "delete", lambda name: (_ for _ in ()).throw(OSError("lost")))
        upserts(spark, state, (6,))
        try:
            state.compact(6)
        except OSError:
            pass
    assert state.bases()[0] == 6
    again = health_state(spark, tmp_path, 4)
    assert held(again) == {**before, "c6": "hc-6"}
    upserts(spark, again, range(7, 12))
    assert held(again) == {f"c{c}": f"hc-{max(i for i in range(12) if i % 7 == c)}" for c in range(7)}


def test_latest_health_compacts_as_it_runs(spark, tmp_path):
    batches = [[check(i, f"c{i % 3}", at(i), "down")] for i in range(9)]
    root = str(tmp_path / "health")
    got = run.latest_health_stream(feed(spark, tmp_path, CHECK, *batches), root, 4, compact_every=2)
    assert {r["client_id"]: r["id"] for r in got.collect()} == {"c0": "hc-6", "c1": "hc-7", "c2": "hc-8"}


def test_operations_without_completion_come_out(spark, tmp_path):
    hour = 3600
    log = feed(spark, tmp_path, "id long, started_at timestamp, completed_at timestamp",
               [(1, at(0), None), (2, at(5), None), (3, at(9), None)], [(1, None, at(90)), (3, None, at(9 + 2 * hour))],
               [(4, at(10 * hour), None), (4, None, at(10 * hour + 5))], [(7, at(12 * hour), at(12 * hour))], [(2, None, at(70)), (5, at(20 * hour), at(20 * hour))], [(6, at(30 * hour), at(30 * hour))])
    started, completed = log.filter("started_at is not null").select("id", "started_at"), log.filter("completed_at is not null").select("id", "completed_at")
    out, root = flows.operation_outcomes(started, completed), work_dir(spark, "outcomes-test")
    with run.stream_settings(spark, 4):
        query = run.start_to_files(out, f"{root}/rows", f"{root}/checkpoint")
    query.awaitTermination()
    got = {r["operation_id"]: (r["outcome"], r["duration_ms"]) for r in spark.read.schema(out.schema).parquet(f"{root}/rows").collect()}
    # 2 was completed too late to be believed, 3 after its bound; each came out once, and the state let them go.
    assert got == {1: ("completed", 90_000), 2: ("timed_out", None), 3: ("timed_out", None), 4: ("completed", 5_000), 5: ("completed", 0), 6: ("completed", 0), 7: ("completed", 0)}
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert rows[-1] <= 4


def test_finished_builds_are_forgotten(spark, tmp_path):
    poll = lambda i, t, s: (f"dpl_{i}", at(t), s)
    stream = feed(spark, tmp_path, "deployment_id string, polled_at timestamp, ready_state string",
                  [poll(i, 0, "READY") for i in range(20)], [poll(100, 5000, "BUILDING")], [poll(101, 9000, "BUILDING")],
                  [poll(0, 9100, "ERROR")], [poll(102, 20000, "READY")])
    out, root = builds.build_timeout(stream, forget_seconds=600), work_dir(spark, "forget-test")
    with run.stream_settings(spark, 4):
        query = run.start_to_files(out, f"{root}/rows", f"{root}/checkpoint")
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) >= 20 and rows[-1] < 10
    got = sorted((r["deployment_id"], r["state"]) for r in spark.read.schema(out.schema).parquet(f"{root}/rows").collect())
    # The poll after the state went starts a new build of the same name.
    assert [x for x in got if x[0] == "dpl_0"] == [("dpl_0", "ERROR"), ("dpl_0", "READY")] and ("dpl_100", "TIMEOUT") in got


def test_unsafe_feed(spark, tmp_path):
    schema = "id long, audit_ts timestamp, operation string, model string, client_slug string, security_level string, url_path string, space_mode string"
    row = lambda i, level: (i, at(i), "get_content", "page", None, level, "/", "SHARED")
    got = run_to_table(flows.unsafe_alerts(feed(spark, tmp_path, schema, [row(1, "SAFE"), row(2, "UNSAFE")], [row(3, "UNSAFE")])), "unsafe-test")
    assert sorted(r["id"] for r in got.collect()) == [2, 3]




def test_processor_needs_no_package_on_workers():
    import subprocess
    import sys

    from pyspark import cloudpickle

    data = cloudpickle.dumps(builds.timeout_processor())
    code = "import sys, pickle; p = pickle.loads(sys.stdin.buffer.read()); assert 'fleetspark' not in sys.modules; print(type(p).__name__)"
    done = subprocess.run([sys.executable, "-c", code], input=data, capture_output=True, cwd="/", env={})
    assert done.stdout.strip() == b"BuildTimeout", done.stderr
