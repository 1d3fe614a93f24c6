"""Registered queries: streams, each run over all rows of its table into files."""

from pyspark.sql import functions as F

from fleetspark.catalog.registry import query
from fleetspark.streaming import builds, flows
from fleetspark.session import work_dir
from fleetspark.streaming import run

#: State partitions of the registered streams, which run on small clusters.
STATE_PARTITIONS = 8


def run_to_table(t, stream, name):
    return run.run_to_table(stream, work_dir(t.spark, name), STATE_PARTITIONS)


def _naive(df):
    """Event times back to TIMESTAMP_NTZ, as in the batch tables."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in kinds.items() if kind == "timestamp"})


@query("onboarding_queue", """
SELECT json_extract_string(value, '$.clientId') AS client_id, json_extract_string(value, '$.clientSlug') AS client_slug, json_extract_string(value, '$.tier') AS tier
FROM onboarding_messages WHERE json_valid(value)""")
def _(t):
    # Every third message is delivered twice.
    rows = t.stream("onboarding_messages")
    rows = rows.select("*", F.explode(F.when(F.col("offset_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("delivery"))
    base = F.lit("2024-01-30 00:00:00").cast("timestamp")
    received = rows.withColumn("received_at", base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("offset_id") % 3600))
    queue = run_to_table(t, flows.onboarding_queue(received), "onboarding-queue")
    return queue.select(F.col("clientId").alias("client_id"), F.col("clientSlug").alias("client_slug"), "tier")


@query("unsafe_alerts", """
SELECT id, audit_ts, operation, model, client_slug, url_path, space_mode FROM builderio_query_audit WHERE security_level = 'UNSAFE'""")
def _(t):
    return run_to_table(t, flows.unsafe_alerts(t.stream("builderio_query_audit")), "unsafe-alerts")


@query("latest_health_stream", """
SELECT client_id, 'hc-' || id AS id, checked_at, overall_status, vercel_status FROM site_health_checks
QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY checked_at DESC NULLS FIRST, 'hc-' || id) = 1""")
def _(t):
    checks = t.stream("site_health_checks").withColumn("id", F.concat(F.lit("hc-"), F.col("id").cast("string")))
    return run.latest_health_stream(checks, work_dir(t.spark, "latest-health"), STATE_PARTITIONS).select(
        "client_id", "id", "checked_at", "overall_status", "vercel_status"
    )


@query("build_timeout", """
WITH s AS (SELECT deployment_id, min(polled_at) AS started_at, max(polled_at) AS last_poll FROM deployment_polls GROUP BY 1),
f AS (SELECT s.deployment_id, min((p.polled_at, p.ready_state)) AS fin FROM s JOIN deployment_polls p ON p.deployment_id = s.deployment_id
  WHERE p.ready_state IN ('READY', 'ERROR', 'CANCELED') AND p.polled_at <= s.started_at + INTERVAL 300 SECOND GROUP BY 1)
SELECT 'dpl_' || s.deployment_id AS deployment_id, coalesce(fin[2], 'TIMEOUT') AS state, coalesce(fin[2], '') = 'READY' AS success, s.started_at, coalesce(fin[1], s.started_at + INTERVAL 300 SECOND) AS ended_at
FROM s LEFT JOIN f ON f.deployment_id = s.deployment_id
WHERE fin IS NOT NULL OR s.last_poll > s.started_at + INTERVAL 300 SECOND OR s.started_at + INTERVAL 300 SECOND <= (SELECT max(polled_at) FROM deployment_polls) - INTERVAL 10 MINUTE""")
def _(t):
    polls = flows.event_time(t.stream("deployment_polls"), "polled_at")
    polls = polls.withColumn("deployment_id", F.concat(F.lit("dpl_"), F.col("deployment_id").cast("string")))
    return _naive(run_to_table(t, builds.build_timeout(polls), "build-timeout"))


def _log_streams(t):
    """Starts and completions; some operations complete two hours late, beyond the bound."""
    log = flows.event_time(t.stream("registry_operations_log"), "started_at", "completed_at")
    late = F.when(F.col("id") % 40 == 7, F.expr("INTERVAL 2 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    log = log.withColumn("completed_at", F.col("completed_at") + late)
    return log.filter(F.col("started_at").isNotNull()).select("id", "started_at"), log.filter(F.col("completed_at").isNotNull()).select("id", "completed_at")


@query("operation_outcomes", """
WITH o AS (SELECT id AS operation_id, started_at, CASE WHEN id % 40 <> 7 THEN completed_at END AS completed_at FROM registry_operations_log WHERE started_at IS NOT NULL)
SELECT operation_id, started_at, completed_at, cast(round((epoch_us(completed_at) - epoch_us(started_at)) / 1000.0) AS int) AS duration_ms,
 if(completed_at IS NULL, 'timed_out', 'completed') AS outcome FROM o WHERE started_at < (SELECT max(started_at) - INTERVAL 4 HOUR FROM o)""")
def _(t):
    """Operations whose outcome is certain: those started over four hours before the last."""
    outcomes = _naive(run_to_table(t, flows.operation_outcomes(*_log_streams(t)), "operation-outcomes"))
    last = t.registry_operations_log.agg((F.max("started_at") - F.expr("INTERVAL 4 HOURS")).alias("_last"))
    return outcomes.join(F.broadcast(last), F.col("started_at") < F.col("_last")).drop("_last")


@query("operation_pairing", """
SELECT id AS operation_id, started_at, completed_at, cast(round((epoch_us(completed_at) - epoch_us(started_at)) / 1000.0) AS int) AS duration_ms FROM registry_operations_log
WHERE started_at IS NOT NULL AND completed_at IS NOT NULL AND id % 40 <> 7""")
def _(t):
    started, completed = _log_streams(t)
    return _naive(run_to_table(t, flows.operation_pairing(started, completed), "operation-pairing"))


@query("health_windows", """
WITH w AS (SELECT date_trunc('hour', checked_at)::timestamp AS window_start, overall_status, count(*) AS checks FROM site_health_checks WHERE checked_at IS NOT NULL GROUP BY ALL)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, overall_status, checks FROM w
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(checked_at) - INTERVAL 1 HOUR FROM site_health_checks)""")
def _(t):
    checks = flows.event_time(t.stream("site_health_checks"), "checked_at")
    return _naive(run_to_table(t, flows.health_windows(checks), "health-windows"))
