"""Row changes of the registry as published versions; files without a changed row stay as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.functions.times import moment
from fleetspark.functions.records import derived_uuid
from fleetspark.operators import lifecycle
from fleetspark.sources.registry import conform
from fleetspark.sources.versions import VersionStore

#: Columns that the registry's tables are clustered by, so that changes by client, slug or token touch few files.
CLUSTER = {
    "clients": ("client_slug",), "deleted_sites": ("original_client_id",), "registry_operations_log": ("client_id",),
    "site_deployments": ("client_id",), "site_health_checks": ("client_id",), "platform_inventory": ("client_id",),
    "onboarding_tokens": ("token",),
}


#: Rows from which a table gets more files than it was asked for.
FILE_ROWS = 1 << 17


def publish_registry(store: VersionStore, tables: dict[str, DataFrame], files: int | None = None, file_rows: int = FILE_ROWS) -> int:
    """A version with the given registry tables, in their declared columns: each in ``files`` files, or in
    more where they would hold over ``file_rows`` rows on average."""
    change = store.begin()
    for name, frame in tables.items():
        rows = conform(frame, name)
        change.replace(name, rows, CLUSTER[name], max(files, -(-rows.count() // file_rows)) if files else None)
    return change.commit()


def commit_soft_delete(store: VersionStore, requests: DataFrame, as_of) -> int:
    """Soft deletion of requested clients: changed clients, their snapshots and log rows in one version."""
    change = store.begin()
    asked = requests.select("client_slug").distinct()
    hit = change.read("clients").join(asked, "client_slug", "left_semi")
    _, deleted, log = lifecycle.soft_delete(hit, requests, as_of)
    # Rows get ids from what they say, so a repeated task writes the same ones.
    for table, rows, owner in (("deleted_sites", deleted, "original_client_id"), ("registry_operations_log", log, "client_id")):
        rows = rows.withColumn("id", derived_uuid(F.lit(table), F.col(owner), F.lit(str(as_of))))
        change.append(table, conform(rows, table))
    change.rewrite("clients", asked, lambda part: lifecycle.soft_delete(part, requests, as_of)[0], CLUSTER["clients"])
    return change.commit()


def commit_recover(store: VersionStore, requests: DataFrame, as_of, new_id: Column | None = None) -> int:
    """Recovery of requested slugs: new client rows and marked deleted rows in one version."""
    change = store.begin()
    clients, deleted = change.read("clients"), change.read("deleted_sites")
    rows, marked = lifecycle.recover(deleted, requests, clients, as_of, new_id)
    change.append("clients", rows.drop("original_client_id"))
    done = marked.where(F.col("recovered") & (F.col("recovered_at") == moment(as_of)))
    ids = done.select("id")
    columns = ["recovered", "recovered_at", "recovered_by", "new_client_id"]
    fresh = done.select(F.col("id").alias("_id"), F.struct(*columns).alias("_new"))

    def marks(part: DataFrame) -> DataFrame:
        joined = part.join(fresh, F.col("id") == F.col("_id"), "left")
        return joined.withColumns({c: F.when(F.col("_id").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns}).drop("_id", "_new")

    change.rewrite("deleted_sites", ids, marks, CLUSTER["deleted_sites"])
    return change.commit()


def commit_cascade(store: VersionStore, gone: DataFrame, owned: list[str], linked: list[str]) -> tuple[int, dict[str, list[str]]]:
    """Deletion of the clients ``gone`` (client_id): owned rows go, links become null.

    Returns the version and, per table, the files that were replaced.
    """
    change = store.begin()
    ids = gone.select("client_id").where("client_id IS NOT NULL").distinct()
    replaced = {}
    for name in owned:
        replaced[name] = change.rewrite(name, ids, lambda part, n=name: lifecycle.cascade_delete(ids, {n: part}, {})[n], CLUSTER[name])
    for name in linked:
        replaced[name] = change.rewrite(name, ids, lambda part, n=name: lifecycle.cascade_delete(ids, {}, {n: part})[n], CLUSTER[name])
    return change.commit(), replaced


def commit_delete_by_slug(store: VersionStore, slugs: DataFrame) -> tuple[int, list[str]]:
    """Clients without those of the slugs (client_slug): the version and the replaced files."""
    change = store.begin()
    replaced = change.rewrite("clients", slugs, lambda part: lifecycle.delete_by_slug(part, slugs), CLUSTER["clients"])
    return change.commit(), replaced


def commit_used_tokens(store: VersionStore, submissions: DataFrame) -> tuple[int, list[str]]:
    """Marks submitted tokens (token) as used: the version and the replaced files."""
    change = store.begin()
    tokens = submissions.select("token").distinct()
    replaced = change.rewrite("onboarding_tokens", tokens, lambda part: lifecycle.consume_tokens(part, tokens), CLUSTER["onboarding_tokens"])
    return change.commit(), replaced


def commit_expired_tokens(store: VersionStore, as_of) -> tuple[int, list[str]]:
    """Drops expired tokens: the version and the replaced files."""
    change = store.begin()
    expired = F.col("expires_at") < moment(as_of)
    replaced = change.rewrite("onboarding_tokens", expired, lambda part: lifecycle.expire_tokens(part, as_of), CLUSTER["onboarding_tokens"])
    return change.commit(), replaced
