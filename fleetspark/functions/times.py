"""Column expressions on timestamps.  ``as_of`` stands for the current time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

RECOVERY_DAYS = 30
TOKEN_HOURS = 24
STALE_HOURS = 24
AGING_HOURS = 6


def moment(as_of: datetime | str | Column) -> Column:
    """``as_of`` as a TIMESTAMP_NTZ column; naive values are taken as UTC."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp_ntz")


def hours(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n))


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def day_part(delta: Column) -> Column:
    """Whole days of an interval."""
    return F.extract(F.lit("DAY"), delta).cast("bigint")


def hour_part(delta: Column) -> Column:
    """Hour component (0 to 23) of an interval, not its total hours."""
    return F.extract(F.lit("HOUR"), delta).cast("bigint")


def micros(delta: Column) -> Column:
    """Interval length in microseconds, exact and free of the session time zone."""
    part = lambda unit: F.extract(F.lit(unit), delta)
    whole = part("DAY").cast("bigint") * 86_400 + part("HOUR") * 3_600 + part("MINUTE") * 60
    return whole * 1_000_000 + (part("SECOND") * 1_000_000).cast("bigint")


def total_hours(delta: Column) -> Column:
    return micros(delta) / F.lit(3.6e9)


def duration_ms(started_at: Column, completed_at: Column) -> Column:
    """Milliseconds between two moments, rounded half away from zero; null if either is null."""
    return F.round(micros(completed_at - started_at) / F.lit(1000.0)).cast("int")


def recovery_deadline(deleted_at: Column, deadline: Column | None = None) -> Column:
    default = deleted_at + days(RECOVERY_DAYS)
    return default if deadline is None else F.coalesce(deadline, default)


def token_expiry(created_at: Column) -> Column:
    return created_at + hours(TOKEN_HOURS)


def check_freshness(last_check_at: Column, as_of) -> Column:
    age = moment(as_of) - last_check_at
    return (
        F.when(last_check_at.isNull(), "never_checked")
        .when(age > hours(STALE_HOURS), "stale")
        .when(age > hours(AGING_HOURS), "aging")
        .otherwise("fresh")
    )
