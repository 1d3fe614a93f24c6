"""Onboarding messages: JSON text to columns and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.functions.forms import ENTRY_TIER
from fleetspark.functions.records import computed_once, parsed_doc, parsed_json
from fleetspark.schemas import MESSAGE

FIELDS = ["clientId", "clientSlug", "clientName", "contactEmail", "websiteType", "tier", "metadata", "builder"]


def parse_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """Add the message fields, and ``rejected`` with the raw text of a message that cannot be used.

    Rejected are malformed JSON and messages without client id or slug.
    """
    parsed = computed_once(df, _raw=parsed_json(F.col(value), MESSAGE)).withColumn("_m", parsed_doc("_raw"))
    bad = F.col("_m.clientId").isNull() | F.col("_m.clientSlug").isNull()
    fields = [F.when(~bad, F.col(f"_m.{name}")).alias(name) for name in FIELDS]
    return parsed.select(*df.columns, *fields, F.when(bad, F.col(value)).alias("rejected"))


# Who sends a message.
FORM_SENDER = ("onboarding-form", "admin-dashboard")
GENERATOR_SENDER = ("site-generator", "generate-website-tool")


def _messages(rows: DataFrame, message_id: Column, sender: tuple[str, str], requested_at: Column, meta: list[Column], builder) -> DataFrame:
    tier = F.coalesce("tier", F.lit(ENTRY_TIER))
    head = F.struct(
        F.lit(sender[0]).alias("initiatedBy"),
        F.lit(sender[1]).alias("onboardingSource"),
        F.date_format(requested_at, "yyyy-MM-dd'T'HH:mm:ss").alias("requestedAt"),
        *meta,
    )
    parts = [
        message_id.alias("clientId"),
        F.col("client_slug").alias("clientSlug"),
        F.col("client_name").alias("clientName"),
        F.col("contact_email").alias("contactEmail"),
        F.coalesce("website_type", F.lit("marketing")).alias("websiteType"),
        tier.alias("tier"),
        head.alias("metadata"),
    ]
    # to_json leaves null fields out, so an absent part is no key of the message.
    if builder is not None:
        parts.append(F.when(tier != ENTRY_TIER, builder).alias("builder"))
    return rows.select(F.struct(*parts).alias("_m")).select(F.col("_m.clientId").alias("clientId"), F.to_json("_m").alias("value"))


def onboarding_messages(forms: DataFrame, message_id: Column, requested_at: Column, client_id: Column | None = None) -> DataFrame:
    """(clientId, value): one JSON message per form row.

    Clients of the entry tier bring no keys, so their message has no builder part.
    ``client_id`` is the id the registry gave the client.
    """
    keys = F.struct(
        F.col("builder_public_key").alias("publicKey"),
        F.col("builder_private_key").alias("privateKey"),
        (F.coalesce("builder_space_id", F.lit("")) if "builder_space_id" in forms.columns else F.lit("")).alias("spaceId"),
    )
    meta = [] if client_id is None else [client_id.alias("supabaseClientId")]
    return _messages(forms, message_id, FORM_SENDER, requested_at, meta, keys)


def provisioning_messages(clients: DataFrame, requested_at: Column) -> DataFrame:
    """(clientId, value): one message per generated client, with its site and repository."""
    rows = clients.withColumn("tier", F.col("builder_space_tier"))
    meta = [F.col("staging_url").alias("stagingUrl"), F.col("github_repo").alias("githubRepo")]
    return _messages(rows, F.col("id"), GENERATOR_SENDER, requested_at, meta, None)


def publish(messages: DataFrame, target: dict[str, str]) -> None:
    """Write (clientId, value) to a topic ({"topic": …, options}) or to files ({"path": …})."""
    if "path" in target:
        messages.select("value").write.mode("append").text(target["path"])
    else:
        rows = messages.select(F.col("clientId").alias("key"), "value")
        rows.write.format("kafka").options(**target).save()
