"""Row changes as transforms: table in, changed table out.

Parquet tables take no UPDATE, DELETE or MERGE, so a changed table is written as
a new version.  On a table format with row changes the same columns go into MERGE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fleetspark.functions.records import changed, clamped, derived_uuid, is_false, json_key
from fleetspark.functions.times import days, moment, recovery_deadline
from fleetspark.operators.joins import latest_health
from fleetspark.schemas import TABLES, table_schema

# Status words and column defaults.
DELETED = "deleted"
CLIENT_DEFAULTS = {"contact_email": "", "website_type": "marketing", "status": "pending_provisioning"}
WARNING_DAYS = [7, 1]


def mark_orphaned(inventory: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Set is_orphaned where no client is linked; ``observation`` gets ``updated`` rows."""
    hit = F.col("client_id").isNull() & is_false("is_orphaned")
    out = inventory
    if observation is not None:
        out = out.observe(observation, F.count_if(hit).alias("updated"))
    return out.withColumn("is_orphaned", F.when(hit, True).otherwise(F.col("is_orphaned")))


def sync_inventory(inventory: DataFrame, clients: DataFrame, slugs: DataFrame, as_of) -> DataFrame:
    """Relink the resources of the given slugs; a slug without client gets a null link."""
    ids = clients.select(F.col("client_slug").alias("_slug"), F.col("id").alias("_client"))
    sync = slugs.select(F.col("client_slug").alias("_wanted")).distinct()
    sync = sync.join(ids, F.col("_wanted") == F.col("_slug"), "left").drop("_slug")
    joined = inventory.join(sync, F.col("client_slug") == F.col("_wanted"), "left")
    hit = F.col("_wanted").isNotNull()
    return joined.withColumns({
        "client_id": F.when(hit, F.col("_client")).otherwise(F.col("client_id")),
        "is_orphaned": F.when(hit, False).otherwise(F.col("is_orphaned")),
        "last_verified_at": F.when(hit, moment(as_of)).otherwise(F.col("last_verified_at")),
    }).drop("_wanted", "_client")


def apply_space_delta(spaces: DataFrame, space_id: Column | int, delta: int, as_of) -> DataFrame:
    """One change of one space's counter; an unknown counter becomes 0."""
    hit = F.col("id") == space_id
    return spaces.withColumns({
        "active_clients": F.when(hit, clamped(F.col("active_clients"), F.lit(delta))).otherwise(F.col("active_clients")),
        "updated_at": F.when(hit, moment(as_of)).otherwise(F.col("updated_at")),
    })


def apply_space_deltas(spaces: DataFrame, deltas: DataFrame, as_of, partitions: int | None = None) -> DataFrame:
    """A batch of counter changes (space_id, requested_at, id, delta), in order, each clamped at zero.

    The first change of an unknown counter gives 0, as it does alone.

    A run of clamped changes turns n into S + max(n, -m), with S the sum of the run
    and m its smallest prefix sum.  Runs compose, so the ordered batch is cut into
    ranges, each range is summed up by itself, and the summaries, a few per space,
    are combined.  No space is folded in one task, however many changes it has.
    """
    spark = deltas.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = deltas.select("space_id", "requested_at", "id", F.col("delta").cast("bigint").alias("delta"))
    ranged = ordered.repartitionByRange(n, "space_id", "requested_at", "id").withColumn("_range", F.spark_partition_id())
    upto = (Window.partitionBy("space_id", "_range").orderBy("requested_at", "id")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = (
        ranged.withColumn("_prefix", F.sum("delta").over(upto))
        .groupBy("space_id", "_range")
        .agg(F.sum("delta").alias("_sum"), F.min("_prefix").alias("_low"))
    )
    before = Window.partitionBy("space_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    total = placed.groupBy(F.col("space_id").alias("_space")).agg(
        F.sum("_sum").alias("_sum"), F.min(F.col("_before") + F.col("_low")).alias("_low")
    )
    joined = spaces.join(total, F.col("id") == F.col("_space"), "left")
    # A null start is left out by greatest, which is a start below every prefix sum.
    folded = (F.col("_sum") + F.greatest(F.col("active_clients"), -F.col("_low"))).cast("int")
    hit = F.col("_space").isNotNull()
    return joined.withColumns({
        "active_clients": F.when(hit, folded).otherwise(F.col("active_clients")),
        "updated_at": F.when(hit, moment(as_of)).otherwise(F.col("updated_at")),
    }).drop("_space", "_sum", "_low")


def expire_tokens(tokens: DataFrame, as_of) -> DataFrame:
    """Tokens without those that expired before as_of; one without a time stays."""
    return tokens.filter(~F.coalesce(F.col("expires_at") < moment(as_of), F.lit(False)))


def consume_tokens(tokens: DataFrame, submissions: DataFrame) -> DataFrame:
    """Set ``used`` on submitted tokens."""
    seen = submissions.select(F.col("token").alias("_seen")).distinct()
    joined = tokens.join(seen, F.col("token") == F.col("_seen"), "left")
    return joined.withColumn("used", F.col("used") | F.col("_seen").isNotNull()).drop("_seen")


def token_validity(submissions: DataFrame, tokens: DataFrame, as_of) -> DataFrame:
    """Submissions with ``validity``: missing, used, expired (after its time) or valid."""
    known = tokens.select(
        F.col("token").alias("_token"), F.col("used").alias("_used"), F.col("expires_at").alias("_expires"),
        F.col("client_slug").alias("client_slug"),
    )
    joined = submissions.join(known, F.col("token") == F.col("_token"), "left")
    state = (
        F.when(F.col("_token").isNull(), "missing")
        .when(F.col("_used"), "used")
        .when(moment(as_of) > F.col("_expires"), "expired")
        .otherwise("valid")
    )
    slug = F.when(F.col("validity") == "valid", F.col("client_slug"))
    return joined.withColumn("validity", state).withColumn("client_slug", slug).drop("_token", "_used", "_expires")


def snapshot_rows(clients: DataFrame) -> DataFrame:
    """(original_client_id, client_data): each whole row as JSON, null fields included."""
    everything = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return clients.select(F.col("id").alias("original_client_id"), everything.alias("client_data"))


def soft_delete(clients: DataFrame, requests: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete requested clients (client_slug, deleted_by, reason) with a recovery window.

    Returns the changed clients, the new deleted_sites rows and the log rows.
    A request without deleted_by is ignored; several for one slug count once.
    """
    asked = (
        requests.filter(F.coalesce("deleted_by", F.lit("")) != "")
        .groupBy(F.col("client_slug").alias("_slug"))
        .agg(F.min(F.struct("deleted_by", "reason")).alias("_request"))
    )
    now = moment(as_of)
    due = F.col("_slug").isNotNull() & F.col("deletion_scheduled_at").isNull()
    joined = clients.join(asked, F.col("client_slug") == F.col("_slug"), "left")
    changed_clients = joined.withColumns({
        "status": F.when(due, DELETED).otherwise(F.col("status")),
        "deletion_scheduled_at": F.when(due, now).otherwise(F.col("deletion_scheduled_at")),
    }).drop("_slug", "_request")
    hit = joined.filter(due)
    everything = F.to_json(F.struct(*[F.col(c) for c in clients.columns]), {"ignoreNullFields": "false"})
    deleted = hit.select(
        F.col("id").alias("original_client_id"),
        everything.alias("client_data"),
        now.alias("deleted_at"),
        F.col("_request.deleted_by").alias("deleted_by"),
        F.col("_request.reason").alias("deletion_reason"),
        recovery_deadline(now).alias("recovery_deadline"),
        *[F.lit(False).alias(c) for c in ("recovered", "permanently_deleted")],
    )
    log = hit.select(
        F.lit("delete").alias("operation_type"), F.lit("success").alias("operation_status"),
        F.col("id").alias("client_id"), "client_slug", now.alias("started_at"), now.alias("completed_at"),
        F.col("_request.deleted_by").alias("initiated_by"),
    )
    return changed_clients, deleted, log


def recovery_eligibility(deleted_sites: DataFrame, as_of) -> DataFrame:
    """Deleted sites with ``eligible`` and ``reason``."""
    deadline = recovery_deadline(F.col("deleted_at"), F.col("recovery_deadline"))
    reason = (
        F.when(F.col("recovered"), "already recovered")
        .when(F.col("permanently_deleted"), "permanently deleted")
        .when(~(deadline > moment(as_of)), "recovery window closed")
    )
    return deleted_sites.withColumns({"eligible": reason.isNull(), "reason": reason})


def recover(deleted_sites: DataFrame, requests: DataFrame, clients: DataFrame, as_of, new_id: Column | None = None):
    """Recover requested slugs (client_slug, recovered_by): (new client rows, changed deleted_sites).

    A new client has all fields of the snapshot, with a new id, active and no longer scheduled
    for deletion.  Of several deletions of one slug the newest eligible one is recovered, and
    none while a live client has the slug; ``recovery_error`` says why a request was refused.
    A new id is made from the deleted row and the time, so both frames agree on it.
    """
    asked = requests.groupBy(F.col("client_slug").alias("_slug")).agg(F.min("recovered_by").alias("_by"))
    live = clients.filter(~F.col("status").eqNullSafe(DELETED)).select(F.col("client_slug").alias("_live")).distinct()
    keyed = recovery_eligibility(deleted_sites, as_of).withColumn("_key", json_key(deleted_sites, "client_data", "client_slug"))
    # One row per slug: the newest eligible deletion.
    newest = keyed.filter("eligible").groupBy(F.col("_key").alias("_top_key")).agg(F.max("deleted_at").alias("_top_at"))
    first = (
        keyed.filter("eligible").join(newest, (F.col("_key") == F.col("_top_key")) & F.col("deleted_at").eqNullSafe(F.col("_top_at")))
        .groupBy("_top_key").agg(F.min("id").alias("_top_id"))
    )
    joined = (
        keyed.join(asked, F.col("_key") == F.col("_slug"), "left").join(first, F.col("_key") == F.col("_top_key"), "left")
        .join(live, F.col("_key") == F.col("_live"), "left")
    )
    wanted = F.col("_slug").isNotNull()
    error = F.when(wanted, F.coalesce(
        "reason", F.when(F.col("_live").isNotNull(), "slug in use").when(F.col("id") != F.col("_top_id"), "newer deletion recovered"),
    ))
    fresh = derived_uuid(F.col("id").cast("string"), F.lit(str(as_of))) if new_id is None else new_id
    marked = joined.withColumn("recovery_error", error)
    go = F.col("_slug").isNotNull() & F.col("recovery_error").isNull()
    marked = marked.withColumn("_new", F.when(go, fresh))
    data = F.from_json("client_data", TABLES["clients"])
    rows = marked.filter(go).select(F.col("_new"), "original_client_id", data.alias("_data"))
    changed_fields = {"id": F.col("_new"), "status": F.lit("active"), "created_at": moment(as_of), "updated_at": moment(as_of), "deletion_scheduled_at": F.lit(None).cast("timestamp_ntz")}
    fields = [changed_fields.get(f.name, F.col(f"_data.{f.name}")).alias(f.name) for f in table_schema("clients")]
    done = marked.withColumns({
        "recovered": F.when(go, True).otherwise(F.col("recovered")),
        "recovered_at": F.when(go, moment(as_of)).otherwise(F.col("recovered_at")),
        "recovered_by": F.when(go, F.col("_by")),
        "new_client_id": F.when(go, F.col("_new")).otherwise(F.col("new_client_id")),
    }).drop("_slug", "_by", "_new", "_key", "_top_key", "_top_id", "_live", "eligible", "reason")
    return rows.select(*fields, "original_client_id"), done


def purge_due(deleted_sites: DataFrame, as_of) -> DataFrame:
    """Unrecovered, unpurged sites with ``stage``: due, warn_1_day, warn_7_days or waiting."""
    now, deadline = moment(as_of), recovery_deadline(F.col("deleted_at"), F.col("recovery_deadline"))
    open_rows = deleted_sites.filter(is_false("recovered") & is_false("permanently_deleted"))
    stage = F.when(deadline < now, "due")
    for n in sorted(WARNING_DAYS):
        stage = stage.when(deadline <= now + days(n), f"warn_{n}_day" + ("s" if n > 1 else ""))
    return open_rows.select(
        "id", "original_client_id", deadline.alias("deadline"), stage.otherwise("waiting").alias("stage")
    )


def touch_updated_at(old: DataFrame, new: DataFrame, key: str, columns: list[str], as_of) -> DataFrame:
    """``new`` with updated_at set to as_of on rows that differ from ``old``."""
    before = old.select(F.col(key).alias("_key"), F.struct(*columns).alias("_row"), F.col("updated_at").alias("_at"))
    joined = new.drop("updated_at").join(before, F.col(key) == F.col("_key"), "left")
    moved = changed(F.struct(*columns), F.col("_row"))
    return joined.withColumn("updated_at", F.when(moved, moment(as_of)).otherwise(F.col("_at"))).drop("_key", "_row", "_at")


def cascade_delete(gone: DataFrame, owned: dict[str, DataFrame], linked: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Effects of deleting the clients ``gone`` (client_id): owned rows go, links become null."""
    ids = gone.select("client_id").distinct()
    out = {name: df.join(ids, "client_id", "left_anti") for name, df in owned.items()}
    marks = ids.select(F.col("client_id").alias("_gone"))
    for name, df in linked.items():
        joined = df.join(marks, F.col("client_id") == F.col("_gone"), "left")
        out[name] = joined.withColumn("client_id", F.when(F.col("_gone").isNull(), F.col("client_id"))).drop("_gone")
    return out


def backfill_defaults(clients: DataFrame) -> DataFrame:
    return clients.fillna(CLIENT_DEFAULTS)


def evolve_schema(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Add each missing column as (type, default); present ones stay as they are."""
    missing = {name: F.lit(value).cast(kind) for name, (kind, value) in columns.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def refresh_health_status(clients: DataFrame, checks: DataFrame) -> DataFrame:
    """Clients with health_status and last_health_check_at of their newest check.

    'error' is no client status and becomes 'unknown'.
    """
    newest = latest_health(checks.select("id", "client_id", "overall_status", "checked_at")).select(
        F.col("client_id").alias("_client"),
        F.when(F.col("overall_status") == "error", "unknown").otherwise(F.col("overall_status")).alias("_status"),
        F.col("checked_at").alias("_at"),
    )
    joined = clients.join(newest, F.col("id") == F.col("_client"), "left")
    return joined.withColumns({
        "health_status": F.coalesce("_status", "health_status"),
        "last_health_check_at": F.coalesce("_at", "last_health_check_at"),
    }).drop("_client", "_status", "_at")


def delete_by_slug(df: DataFrame, slugs) -> DataFrame:
    """Rows without those of one slug, or of any slug of a DataFrame; null slugs stay."""
    if isinstance(slugs, DataFrame):
        return df.join(slugs.select("client_slug").distinct(), "client_slug", "left_anti")
    return df.filter(~F.col("client_slug").eqNullSafe(F.lit(slugs)))


def update_operations(old: DataFrame, new: DataFrame, duration: Column) -> DataFrame:
    """``new`` with duration_ms recomputed where completed_at changed."""
    before = old.select(F.col("id").alias("_id"), F.col("completed_at").alias("_completed"))
    joined = new.join(before, F.col("id") == F.col("_id"), "left")
    both = F.col("completed_at").isNotNull() & F.col("started_at").isNotNull()
    moved = changed(F.col("completed_at"), F.col("_completed")) & F.col("_id").isNotNull()
    return joined.withColumn("duration_ms", F.when(moved & both, duration).otherwise(F.col("duration_ms"))).drop("_id", "_completed")
