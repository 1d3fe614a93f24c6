"""Streaming versions of the onboarding queue, alerts, health state and operation timing.

Event-time columns are TIMESTAMP (UTC): Spark takes no watermark on TIMESTAMP_NTZ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.functions.times import duration_ms
from fleetspark.plans.views import PLATFORM_STATES
from fleetspark.sources.messages import FIELDS, parse_messages


def event_time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def onboarding_queue(messages: DataFrame, at: str = "received_at", delay: str = "1 hour") -> DataFrame:
    """Valid provisioning requests; a redelivered client id within the delay is dropped."""
    parsed = parse_messages(messages).filter(F.col("rejected").isNull())
    unique = parsed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["clientId"])
    return unique.select(at, *FIELDS)


def unsafe_alerts(audit: DataFrame) -> DataFrame:
    """Content queries without a tenant filter, as they arrive."""
    return audit.filter(F.col("security_level") == "UNSAFE").select(
        "id", "audit_ts", "operation", "model", "client_slug", "url_path", "space_mode"
    )


def health_windows(checks: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Checks per tumbling window and status; later rows than the delay are dropped."""
    counts = (
        checks.withWatermark("checked_at", delay)
        .groupBy(F.window("checked_at", width), "overall_status")
        .agg(F.count("*").alias("checks"))
    )
    return counts.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "overall_status", "checks"
    )


def operation_pairing(started: DataFrame, completed: DataFrame, longest: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Start and completion events of one operation joined to its duration.

    The time bound lets Spark drop the state of operations that never complete.
    """
    begin = started.withWatermark("started_at", delay).select(F.col("id").alias("operation_id"), "started_at")
    end = completed.withWatermark("completed_at", delay).select(F.col("id").alias("_id"), "completed_at")
    within = F.expr(
        "_id = operation_id AND completed_at >= started_at "
        f"AND completed_at <= started_at + INTERVAL {longest}"
    )
    joined = begin.join(end, within, "inner")
    return joined.select(
        "operation_id", "started_at", "completed_at", duration_ms(F.col("started_at"), F.col("completed_at")).alias("duration_ms")
    )


def operation_outcomes(started: DataFrame, completed: DataFrame, longest: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Every started operation once: with its completion, or as ``timed_out`` when none can come any more.

    A left outer join of two streams.  A start waits in the state until the watermark has passed its
    bound; then it comes out without completion, and the state lets it go.  Starts later than the
    delay are dropped, and so are completions.
    """
    begin = started.withWatermark("started_at", delay).select(F.col("id").alias("operation_id"), "started_at")
    end = completed.withWatermark("completed_at", delay).select(F.col("id").alias("_id"), "completed_at")
    within = F.expr(f"_id = operation_id AND completed_at >= started_at AND completed_at <= started_at + INTERVAL {longest}")
    joined = begin.join(end, within, "left_outer")
    return joined.select(
        "operation_id", "started_at", "completed_at", duration_ms(F.col("started_at"), F.col("completed_at")).alias("duration_ms"),
        F.when(F.col("completed_at").isNull(), "timed_out").otherwise("completed").alias("outcome"),
    )


def newest_checks(checks: DataFrame) -> DataFrame:
    """Newest check per client, of a table or, in update mode, of a stream; no time counts as
    newest, ties go to the smaller id.  A stream keeps one row per client as state."""
    order = F.struct(F.col("checked_at").isNotNull().alias("timed"), (-F.unix_micros(F.col("checked_at").cast("timestamp"))).alias("age"), F.col("id"))
    row = F.struct("id", "checked_at", "overall_status", *PLATFORM_STATES)
    return checks.groupBy("client_id").agg(F.min_by(row, order).alias("_row")).select("client_id", "_row.*")
