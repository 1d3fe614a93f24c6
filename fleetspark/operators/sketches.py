"""Generation metrics that add up: per day and key counts, sums and a quantile sketch of the seconds.

Daily rows are written once; any span of days and any coarser key is a merge of them, without the
runs.  The sketch (KLL) is a few kilobytes whatever the number of runs, so no key's distinct values
meet in one task, as they do for the exact percentile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.sources.versions import VersionStore

#: Size of the sketches.
K = 400
VALUE = "generation_time_seconds"
COUNTS = ("runs", "succeeded", "timed", "components", "files")


def rank_error(k: int = K) -> float:
    """Share of all values by which a quantile's rank is off at most, with 99 % certainty per answer."""
    return 2.446 / k**0.9433


def daily_metrics(generations: DataFrame, keys: list[str], at: str = "created_at", k: int = K) -> DataFrame:
    """(day, keys, runs, succeeded, timed, components, files, seconds, sketch); rows without a time have day null."""
    value = F.col(VALUE)
    return generations.groupBy(F.to_date(at).alias("day"), *keys).agg(
        F.count("*").alias("runs"), F.count_if("success").alias("succeeded"), F.count(value).alias("timed"),
        F.sum("components_generated").cast("bigint").alias("components"), F.sum("files_generated").cast("bigint").alias("files"),
        F.sum(value.cast("decimal(20,2)")).alias("seconds"), F.kll_sketch_agg_double(value.cast("double"), k).alias("sketch"),
    )


def rolled_up(daily: DataFrame, keys: list[str], fractions: dict[str, float] | None = None, k: int = K) -> DataFrame:
    """Daily rows merged over ``keys``, with the mean and quantiles (name -> fraction) of the seconds."""
    fractions = {"p95_seconds": 0.95} if fractions is None else fractions
    merged = daily.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.sum("seconds").alias("seconds"), F.kll_merge_agg_double("sketch", k).alias("sketch")
    )
    return merged.select(
        *keys, *COUNTS, (F.col("succeeded") / F.col("runs")).alias("success_rate"), (F.col("seconds").cast("double") / F.col("timed")).alias("mean_seconds"),
        *[quantile("sketch", fraction).alias(name) for name, fraction in fractions.items()],
    )


def quantile(sketch: str, fraction: float) -> Column:
    """A sketch's quantile; null for one without values, which has none to ask for."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(fraction)))


def rank_errors(generations: DataFrame, quantiles: DataFrame, keys: list[str], name: str, fraction: float) -> DataFrame:
    """(keys, rank_error): by which share of a key's values its quantile lies off the fraction."""
    joined = generations.where(F.col(VALUE).isNotNull()).join(quantiles.select(*keys, F.col(name).alias("_q")), keys)
    value = F.col(VALUE).cast("double")
    counted = joined.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(value < F.col("_q")).alias("_below"), F.count_if(value <= F.col("_q")).alias("_upto"))
    off = F.greatest(F.lit(0.0), F.col("_below") / F.col("_n") - fraction, F.lit(fraction) - F.col("_upto") / F.col("_n"))
    return counted.select(*keys, off.alias("rank_error"))


def refresh_days(store: VersionStore, generations: DataFrame, days: DataFrame, keys: list[str], table: str = "daily_metrics") -> int:
    """Compute the given days (day) anew from ``generations`` and put them in the place of what is stored.

    Only runs of these days are aggregated, and only files that hold rows of them rewritten.
    """
    days = days.select("day").distinct()
    runs = generations.join(days.withColumnRenamed("day", "_day"), F.to_date("created_at") == F.col("_day"), "left_semi")
    change = store.begin()
    if table in store.lists():
        change.rewrite(table, days, lambda part: part.join(days, "day", "left_anti"), ("day",))
    change.append(table, daily_metrics(runs, keys), ("day",))
    return change.commit()
