"""Column expressions on registry records: JSON fields, flags, counters, states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status words and recommendations.
PLATFORM_FLAGS = ["github_deleted", "vercel_deleted", "builder_deleted", "gcs_deleted"]
SEVERITY = ["down", "degraded", "unknown", "healthy"]
GATE_RECOMMENDATIONS = {
    "pending_provisioning": "Wait for provisioning workflow to complete",
    "pending_onboarding": "Complete onboarding first",
    "inactive": "Client has been deactivated",
    "unknown": "Check client status in Supabase",
}
GATE_DEFAULT = "Contact support"
GATE_NOT_FOUND = "Please onboard the client first using the client_onboarding tool"


def is_true(name: str) -> Column:
    """Filter on a flag.  Spark turns ``flag = true`` into the bare column, which it does not push to files; this it does."""
    return F.col(name).eqNullSafe(True)


def is_false(name: str) -> Column:
    return F.col(name).eqNullSafe(False)


def json_text(doc: Column, key: str) -> Column:
    """Text of a top-level JSON key; JSON null and a missing key are null."""
    return F.get_json_object(doc, f"$.{key}")


def extracted_name(doc: str, key: str) -> str:
    """Column that holds a JSON key extracted when the row was written."""
    return f"{doc}__{key}"


def json_key(df: DataFrame, doc: str, key: str) -> Column:
    """Text of a JSON key: the extracted column if the table has one, else read from the JSON."""
    name = extracted_name(doc, key)
    if name in df.columns and df.schema[name].dataType.simpleString() == "string":
        return F.col(name)
    return json_text(F.col(doc), key)


def json_value(df: DataFrame, doc: str, key: str, kind: str) -> Column:
    """A JSON key as a value of a type; null where the text is none."""
    name = extracted_name(doc, key)
    if name in df.columns and df.schema[name].dataType.simpleString() == kind:
        return F.col(name)
    return json_key(df, doc, key).try_cast(kind)


def platform_success(result: Column) -> Column:
    """'success' only if the result says so; an absent result counts as failed."""
    return F.when(json_text(result, "success") == "true", "success").otherwise("failed")


def error_count(messages: Column) -> Column:
    """Number of messages; an empty array is null, as is a null one."""
    return F.when(F.size(messages) > 0, F.size(messages))


def deletion_progress(*flags: Column) -> Column:
    """Percent of true flags; a null flag counts as not done."""
    done = reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags])
    return done.cast("double") / F.lit(float(len(flags))) * F.lit(100.0)


def clamped(counter: Column, delta: Column) -> Column:
    """Counter plus delta, never below zero."""
    return F.greatest(F.lit(0), counter + delta)


def changed(a: Column, b: Column) -> Column:
    """True where two values differ, nulls compared as values."""
    return ~a.eqNullSafe(b)


def severity_rank(status: Column) -> Column:
    """Position in the severity order; a null or other status has no rank."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), status)
    return F.when(rank > 0, rank)


def overall_health(github: Column, vercel: Column, builder: Column, gcs: Column, url: Column) -> Column:
    """One status from five: hosting or URL down is down, all healthy is healthy."""
    states = F.array_compact(F.array(github, vercel, builder, gcs, url))
    return (
        F.when(F.size(states) == 0, "error")
        .when(vercel.eqNullSafe("down") | url.eqNullSafe("down"), "down")
        .when(F.forall(states, lambda s: s == "healthy") & (F.size(states) == 5), "healthy")
        .otherwise("degraded")
    )


def token_state(used: Column, expires_at: Column, as_of: Column) -> Column:
    """Report label: used, expired or active."""
    return F.when(used, "used").when(expires_at < as_of, "expired").otherwise("active")


def gate_recommendation(status: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in GATE_RECOMMENDATIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, status), F.lit(GATE_DEFAULT))


def derived_uuid(*parts: Column) -> Column:
    """UUID-shaped id made from values, so a repeated task or a second frame gives the same one."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator.

    Catalyst copies a projected expression into every later use and into pushed
    filters; it does not do so across a generator, so costly parsing runs once.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def parsed_json(text: Column, fields: str) -> Column:
    """A JSON object parsed for ``parsed_doc``.

    Spark stops reading at the end of the first value, whatever follows.  Set into
    an array with a key behind it, a text with anything after its object does not parse.
    """
    whole = F.concat(F.lit('{"_doc": ['), text, F.lit('], "_end": true}'))
    shape = f"_doc array<struct<{fields}>>, _end boolean, _malformed string"
    return F.from_json(whole, shape, {"columnNameOfCorruptRecord": "_malformed", "allowSingleQuotes": "false"})


def parsed_doc(name: str) -> Column:
    """The object in a column made by ``parsed_json``; null unless the whole text was one object."""
    one = F.col(f"{name}._malformed").isNull() & F.col(f"{name}._end") & (F.size(f"{name}._doc") == 1)
    return F.when(one, F.get(F.col(f"{name}._doc"), F.lit(0)))
