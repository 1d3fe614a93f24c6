"""Counts, rates, trends and log summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.functions.records import json_key, overall_health, token_state
from fleetspark.functions.text import NO_LOGS_MESSAGE
from fleetspark.functions.times import moment
from fleetspark.plans.ranking import top_per_key

RESULT_COLUMNS = ["github_result", "vercel_result", "builder_result", "gcs_result", "supabase_result"]
LOG_TYPES = ["stderr", "error"]
LOG_TAIL = 10


def token_status_counts(tokens: DataFrame, as_of) -> DataFrame:
    state = token_state(F.col("used"), F.col("expires_at"), moment(as_of))
    return tokens.groupBy(state.alias("status")).agg(F.count("*").alias("count"))


def listing_counts(listing: DataFrame, owner: str) -> DataFrame:
    """Entries per owner of a listing (repositories, projects, backups)."""
    return listing.groupBy(owner).agg(F.count("*").alias("count"))


def operation_rollup(operations: DataFrame, results: list[str] = RESULT_COLUMNS) -> DataFrame:
    """Per operation: succeeded and failed platforms, and one status from them.

    Platforms without a result are not counted.  All succeeded is success, none
    is failed, a mix is partial_success, and no result at all is in_progress.
    """
    ok = [F.coalesce(json_key(operations, c, "success") == "true", F.lit(False)) for c in results]
    add = lambda flags: reduce(lambda a, b: a + b, [flag.cast("int") for flag in flags])
    won = add([F.col(c).isNotNull() & good for c, good in zip(results, ok)])
    lost = add([F.col(c).isNotNull() & ~good for c, good in zip(results, ok)])
    counted = operations.withColumns({"success_count": won, "failure_count": lost})
    won, lost = F.col("success_count"), F.col("failure_count")
    status = (
        F.when(won + lost == 0, "in_progress").when(lost == 0, "success").when(won == 0, "failed")
        .otherwise("partial_success")
    )
    return counted.withColumn("operation_status", status)


def space_usage(clients: DataFrame, spaces: DataFrame) -> DataFrame:
    """Active clients per shared space; a space is full at its maximum, without one never."""
    used = (
        clients.filter(F.col("builder_shared_space_id").isNotNull())
        .groupBy(F.col("builder_shared_space_id").alias("_space"))
        .agg(F.count_if(F.col("status") == "active").alias("_used"))
    )
    joined = spaces.join(used, F.col("id") == F.col("_space"), "left")
    joined = joined.withColumn("used_clients", F.coalesce("_used", F.lit(0)))
    state = F.when(F.col("used_clients") >= F.col("max_clients"), "full").otherwise(F.col("status"))
    return joined.select(
        "id", "space_name", "tier", "max_clients", "active_clients", "used_clients", state.alias("usage_status")
    )


def with_overall_health(checks: DataFrame) -> DataFrame:
    columns = ["github_status", "vercel_status", "builder_status", "gcs_status", "staging_url_status"]
    return checks.withColumn("derived_status", overall_health(*[F.col(c) for c in columns]))


def generation_metrics(generations: DataFrame, keys: list[str], fraction: float = 0.95) -> DataFrame:
    """Runs, success rate, mean and 95th-percentile seconds, components and files per key.

    The percentile is exact and linearly interpolated.  Runs are first counted per
    key and distinct time, partly before the shuffle, so a key with very many runs
    sends on one row per distinct time; times have two digits, so those are few.
    """
    value = F.col("generation_time_seconds")
    per_time = generations.groupBy(*keys, "generation_time_seconds").agg(
        F.count("*").alias("_runs"), F.count(value).alias("_timed"), F.count_if("success").alias("_won"),
        F.sum("components_generated").alias("_components"), F.sum("files_generated").alias("_files"),
    )
    of_key = Window.partitionBy(*keys)
    upto = of_key.orderBy("generation_time_seconds").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = per_time.withColumns({"_upto": F.sum("_timed").over(upto), "_all": F.sum("_timed").over(of_key)})
    place = (F.col("_all") - 1) * F.lit(fraction)
    at = lambda position: F.min(F.when(F.col("_upto") > position, value))
    low, high = at(F.floor(place)), at(F.ceil(place))
    return placed.groupBy(*keys).agg(
        F.sum("_runs").alias("runs"),
        F.sum("_won").alias("succeeded"),
        (F.sum("_won") / F.sum("_runs")).alias("success_rate"),
        (F.sum(value * F.col("_timed")).cast("double") / F.sum("_timed")).alias("mean_seconds"),
        F.sum("_components").alias("components"),
        F.sum("_files").alias("files"),
        (low + (high - low) * F.max(place - F.floor(place))).cast("double").alias("p95_seconds"),
    )


def health_trend(checks: DataFrame, unit: str = "day") -> DataFrame:
    """Checks per client, time bucket and status."""
    bucket = F.date_trunc(unit, F.col("checked_at")).cast("timestamp_ntz").alias("bucket")
    return checks.groupBy("client_id", bucket, "overall_status").agg(F.count("*").alias("checks"))


def log_tail_text(number: Column, text: Column) -> Column:
    """Lines of a ranked tail joined oldest first; number 1 is the newest."""
    lines = F.sort_array(F.collect_list(F.struct((-number).alias("o"), text.alias("t"))))
    return F.array_join(F.transform(lines, lambda line: line["t"]), "\n")


def build_log_tail(deployments: DataFrame, events: DataFrame, tail: int = LOG_TAIL) -> DataFrame:
    """Last error lines of each deployment's build as one text, or a fixed message."""
    errors = events.filter(F.col("type").isin(LOG_TYPES) & (F.col("text") != ""))
    order = [F.col("created_at").desc(), F.col("event_id").desc()]
    last = top_per_key(errors, ["deployment_id"], order, tail, rank="_n")
    texts = last.groupBy(F.col("deployment_id").alias("_build")).agg(log_tail_text(F.col("_n"), F.col("text")).alias("_logs"))
    joined = deployments.join(texts, F.col("deployment_id") == F.col("_build"), "left")
    return joined.withColumn("build_logs", F.coalesce("_logs", F.lit(NO_LOGS_MESSAGE))).drop("_build", "_logs")
