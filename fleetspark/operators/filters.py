"""Lookups and filtered lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.functions.records import is_false, json_key
from fleetspark.functions.times import hours, moment, total_hours


def lookup_by_slug(clients: DataFrame, slugs, columns: list[str]) -> DataFrame:
    """Clients with a slug: one value, or every slug of a DataFrame."""
    if isinstance(slugs, DataFrame):
        return clients.select("client_slug", *columns).join(slugs.select("client_slug"), "client_slug", "left_semi")
    return clients.filter(F.col("client_slug") == slugs).select("client_slug", *columns)


def single_row(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key: the columns if the key has exactly one row, else nulls and a reason."""
    only = F.count("*") == 1
    picked = [F.when(only, F.any_value(c)).alias(c) for c in columns]
    reason = F.when(only, "ok").otherwise("multiple rows").alias("reason")
    return df.groupBy(*keys).agg(*picked, F.count("*").alias("matches"), reason)


def recent_clients(clients: DataFrame, as_of, window_hours: int = 1) -> DataFrame:
    """Clients created after as_of minus the window, newest first."""
    return clients.filter(F.col("created_at") > moment(as_of) - hours(window_hours)).orderBy(
        F.col("created_at").desc_nulls_first(), "id"
    )


def list_sites(
    clients: DataFrame, status: str | None = None, health_status: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page of sites by slug.  Status 'active' and 'deleted' filter, 'all' and None do not."""
    out = clients
    if status and status != "all":
        out = out.filter(F.col("status") == status)
    if health_status:
        out = out.filter(F.col("health_status") == health_status)
    return out.orderBy("client_slug").offset(offset).limit(limit)


def json_key_filter(df: DataFrame, doc: str, key: str, wanted) -> DataFrame:
    """Rows whose JSON key equals one value, or any value of a one-column DataFrame."""
    text = json_key(df, doc, key)
    if isinstance(wanted, DataFrame):
        values = wanted.toDF("_wanted")
        return df.join(values, text == F.col("_wanted"), "left_semi")
    return df.filter(text == wanted)


def inventory_by_platform(
    inventory: DataFrame, platform: str | None = None, resource_type: str | None = None, is_orphaned: bool | None = None
) -> DataFrame:
    """Inventory rows by any of platform, resource type and orphan flag."""
    out = inventory
    for column, value in (("platform", platform), ("resource_type", resource_type), ("is_orphaned", is_orphaned)):
        if value is not None:
            out = out.filter(F.col(column).eqNullSafe(value))
    return out


def active_tokens(tokens: DataFrame, as_of) -> DataFrame:
    """Unused tokens that expire after as_of, with the hours left, newest first."""
    now = moment(as_of)
    live = tokens.filter(is_false("used") & (F.col("expires_at") > now))
    return live.select(
        "token", "client_slug", "created_at", "expires_at", "used",
        total_hours(F.col("expires_at") - now).alias("hours_until_expiry"),
    ).orderBy(F.col("created_at").desc_nulls_first(), "token")


def recoverable_sites(deleted_sites: DataFrame) -> DataFrame:
    return deleted_sites.filter(is_false("recovered"))


