"""Column expressions on onboarding forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetspark.functions.records import derived_uuid
from fleetspark.functions.times import moment

from fleetspark.functions.text import KEY_PREFIX, python_strip

# Field labels, patterns, limits and messages of the form.
BASE_FIELDS = {
    "client_name": "Client Name",
    "client_slug": "Client Slug",
    "contact_email": "Contact Email",
    "website_type": "Website Type",
}
KEY_FIELDS = {
    "builder_public_key": "Builder.io Public Key",
    "builder_private_key": "Builder.io Private Key",
}
WEBSITE_TYPES = ["marketing", "ecommerce", "documentation", "portfolio", "blog"]
SLUG_PATTERN = "^[a-z0-9][a-z0-9-]*[a-z0-9]$"
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
LEGACY_KEY_PATTERN = "^[a-zA-Z0-9]+$"
SLUG_MIN, SLUG_MAX, KEY_MIN = 3, 30, 20
SLUG_FORMAT_ERROR = "Client Slug must be lowercase, alphanumeric with hyphens only, and cannot start/end with a hyphen"
SLUG_SHORT_ERROR = "Client Slug must be at least 3 characters"
SLUG_LONG_ERROR = "Client Slug must be 30 characters or less"
EMAIL_ERROR = "Please enter a valid email address"
TYPE_ERROR = "Website Type must be one of: " + ", ".join(WEBSITE_TYPES)
PUBLIC_SHORT_ERROR = "Builder.io Public Key appears to be invalid (too short)"
PUBLIC_FORMAT_ERROR = 'Builder.io Public Key must be either a legacy key (alphanumeric) or start with "pub-"'
PRIVATE_SHORT_ERROR = "Builder.io Private Key appears to be invalid (too short)"
ENTRY_TIER = "entry"
NEW_CLIENT_STATUS = "pending_provisioning"

# The project that keeps shared secrets is a setting of an installation.
INTAKE_PROJECT = "shared-intake"


def _matches(text: Column, pattern: str) -> Column:
    # (?d): '$' also matches before one final line feed, and before nothing else.
    return text.rlike("(?d)" + pattern)


def form_errors(f: dict[str, Column] | None = None) -> Column:
    """Ordered array of error messages of one form row; empty for a valid form."""
    f = f or {name: F.col(name) for name in [*BASE_FIELDS, *KEY_FIELDS, "tier"]}
    text = {name: F.coalesce(column, F.lit("")) for name, column in f.items() if name != "tier"}
    keyed = python_strip(F.coalesce(f["tier"], F.lit(ENTRY_TIER))) != ENTRY_TIER
    required = [(name, label, F.lit(True)) for name, label in BASE_FIELDS.items()]
    required += [(name, label, keyed) for name, label in KEY_FIELDS.items()]
    checks = [F.when(needed & (python_strip(text[name]) == ""), f"{label} is required") for name, label, needed in required]

    slug = text["client_slug"]
    checks.append(
        F.when(slug == "", None)
        .when(~_matches(slug, SLUG_PATTERN) & (F.length(slug) >= SLUG_MIN), SLUG_FORMAT_ERROR)
        .when(F.length(slug) < SLUG_MIN, SLUG_SHORT_ERROR)
        .when(F.length(slug) > SLUG_MAX, SLUG_LONG_ERROR)
    )
    email = text["contact_email"]
    checks.append(F.when((email != "") & ~_matches(email, EMAIL_PATTERN), EMAIL_ERROR))
    kind = text["website_type"]
    checks.append(F.when((kind != "") & ~kind.isin(WEBSITE_TYPES), TYPE_ERROR))
    public, private = text["builder_public_key"], text["builder_private_key"]
    checks.append(
        F.when(public == "", None)
        .when(F.length(public) < KEY_MIN, PUBLIC_SHORT_ERROR)
        .when(~(public.startswith(KEY_PREFIX) | _matches(public, LEGACY_KEY_PATTERN)), PUBLIC_FORMAT_ERROR)
    )
    checks.append(F.when((private != "") & (F.length(private) < KEY_MIN), PRIVATE_SHORT_ERROR))
    return F.array_compact(F.array(*checks))


def space_mode(tier: Column) -> Column:
    """Entry clients share a space, all others have their own."""
    return F.when(F.coalesce(tier, F.lit(ENTRY_TIER)) == ENTRY_TIER, "SHARED").otherwise("DEDICATED")


def secret_name(slug: Column, part: str) -> Column:
    return F.concat(F.lit("client-"), slug, F.lit(f"-builder-{part}"))


def client_record(as_of, intake_project: str = INTAKE_PROJECT) -> list[Column]:
    """Columns of a new client row, derived from a form row.  The id is made from the slug and the time."""
    slug, tier = F.col("client_slug"), F.coalesce(F.col("tier"), F.lit(ENTRY_TIER))
    return [
        derived_uuid(slug, F.lit(str(as_of))).alias("id"),
        F.col("client_name"),
        slug,
        F.col("contact_email"),
        F.col("website_type"),
        F.col("industry"),
        tier.alias("builder_space_tier"),
        space_mode(tier).alias("builder_space_mode"),
        F.when(space_mode(tier) == "SHARED", intake_project).alias("gcp_project_id"),
        F.lit(NEW_CLIENT_STATUS).alias("status"),
        secret_name(slug, "public-key").alias("builder_public_key"),
        secret_name(slug, "private-key").alias("builder_private_key"),
        secret_name(slug, "space-id").alias("builder_space_id"),
        moment(as_of).alias("created_at"),
        moment(as_of).alias("updated_at"),
    ]


def generation_space(mode: Column) -> Column:
    """Struct (space_mode, model) of a generation request's mode."""
    shared = mode == "INTAKE"
    return F.struct(
        F.when(shared, "SHARED").otherwise("DEDICATED").alias("space_mode"),
        F.when(shared, "client-page").otherwise("page").alias("model"),
    )
