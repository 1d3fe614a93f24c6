"""Tenant isolation of content requests and entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.functions.records import changed, json_text
from fleetspark.plans.ranking import top_per_key

SCOPE_LIMIT = 100


def tenant_violation(expected: Column, entry_data: Column) -> Column:
    """True where an entry's slug is not the expected one; a missing slug is a violation."""
    return changed(json_text(entry_data, "clientSlug"), expected)


def tenant_check(entries: DataFrame) -> DataFrame:
    """Entries and violations per requested slug and model."""
    wrong = tenant_violation(F.col("requested_slug"), F.col("data"))
    return entries.groupBy("requested_slug", "model").agg(
        F.count("*").alias("entries"), F.count_if(wrong).alias("invalid_entries")
    )


def content_query(entries: DataFrame, model: str, query: dict[str, str] | None = None, limit: int = 20) -> DataFrame:
    """First entries of a model whose JSON data equals every query value."""
    out = entries.filter(F.col("model") == model)
    for key, value in (query or {}).items():
        out = out.filter(json_text(F.col("data"), key) == value)
    return out.orderBy("id").limit(limit)


def tenant_scope(
    requests: DataFrame, entries: DataFrame, models: dict[str, str], by_path: bool = True, limit: int | None = None,
) -> DataFrame:
    """Entries each request gets: (request_id, space_mode, entry_id, position).

    A request only ever sees entries of its own space (``space_id``) and of the content model
    that ``models`` names for its mode.  In a shared space they must also have its slug and
    environment.  A page request (``by_path``) gets the first one of its path, a list request up
    to 100.  Entries are ranked and cut per scope before the join, so one scope never brings
    more than ``limit`` rows to a request.
    """
    limit = limit or (1 if by_path else SCOPE_LIMIT)
    data, order = F.col("data"), [F.col("entry_id").asc()]
    own_keys = {"_space": "space_id"} | ({"_path": "url_path"} if by_path else {})
    shared_keys = own_keys | {"_slug": "client_slug", "_env": "env"}
    found = []
    for mode, keys in {"SHARED": shared_keys, "DEDICATED": own_keys}.items():
        fields = entries.filter(F.col("model") == models[mode]).select(
            F.col("id").alias("entry_id"), F.col("space_id").alias("_space"), json_text(data, "clientSlug").alias("_slug"),
            json_text(data, "urlPath").alias("_path"), json_text(data, "env").alias("_env"),
        )
        asked = requests.filter(F.col("space_mode") == mode).withColumns({key: F.col(source) for key, source in keys.items()})
        first = top_per_key(fields.dropna(subset=list(keys)), list(keys), order, limit, rank="position")
        joined = asked.join(first.select("entry_id", "position", *keys), list(keys), "inner")
        found.append(joined.select("request_id", "space_mode", "entry_id", F.col("position").cast("bigint").alias("position")))
    return found[0].unionByName(found[1])
