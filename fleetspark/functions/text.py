"""Column expressions on slugs, hosts, paths, names, logs and error texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, markers, limits and messages of the service.
LOCAL_HOST_MARKER = "localhost"
LOCAL_SLUG = "development"
PREVIEW_DOMAIN = ".vercel.app"
HASH_SEGMENT_MIN = 8
BUILD_LOG_MARKER = "Build logs:"
ERROR_WORDS = ["error", "failed"]
TOP_ERRORS = 10
ARCHIVE_PREFIX = "ARCHIVED-"
KEY_PREFIX = "pub-"
NO_LOGS_MESSAGE = "Build failed but no error logs available"
ERROR_HELP = [
    (["Vercel"], "Vercel deployment or API error",
     ["Check Vercel API token is valid", "Verify project permissions", "Review Vercel deployment logs"]),
    (["Builder.io", "BuilderIO"], "Builder.io API error",
     ["Check Builder.io API key is valid", "Verify space permissions", "Check Builder.io space quotas"]),
    (["GitHub"], "GitHub API error",
     ["Check GitHub token is valid", "Verify repository permissions", "Check rate limits"]),
    ([], "Unexpected error during site generation",
     ["Review error logs", "Check service configurations", "Contact support if error persists"]),
]
BUILD_FAILURES = {"ERROR": "Build failed on Vercel", "CANCELED": "Build was canceled"}

WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The sites' own domain and backup bucket are settings of an installation.
SITE_DOMAIN = "sites.example"
BACKUP_BUCKET = "site-backups"


def python_strip(text: Column) -> Column:
    """Strip Unicode white space at both ends (Spark's trim strips blanks only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def sanitize_slug(text: Column) -> Column:
    """Lower-case slug: white space and underscores become hyphens, the rest is dropped."""
    hyphened = F.regexp_replace(F.lower(text), r"(?U)[\s\x1c-\x1f_]+", "-")
    kept = F.regexp_replace(hyphened, "[^a-z0-9-]", "")
    return F.btrim(F.regexp_replace(kept, "-{2,}", "-"), F.lit("-"))


def form_slug(text: Column) -> Column:
    """The form's own variant: lower-case and drop, no hyphens added or trimmed."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9-]", "")


def host_to_slug(host: Column, local_slug: str = LOCAL_SLUG) -> Column:
    """Tenant slug of a hostname, or null for a host that names no tenant."""
    label = F.substring_index(host, ".", 1)
    segments = F.split(label, "-")
    hash_at = F.array_position(
        F.transform(segments, lambda s: (F.length(s) >= HASH_SEGMENT_MIN) & s.rlike(r"^[a-z0-9]+\z")), True
    )
    is_preview = F.contains(host, F.lit(PREVIEW_DOMAIN)) & (F.size(segments) > 3) & (hash_at > 1)
    slug = F.when(is_preview, F.call_function("substring_index", label, F.lit("-"), (hash_at - 1).cast("int"))).otherwise(label)
    return (
        F.when(F.contains(host, F.lit(LOCAL_HOST_MARKER)), F.lit(local_slug))
        .when(F.size(F.split(host, r"\.")) < 3, None)
        .when(slug.rlike(r"^[a-z0-9-]+\z"), slug)
    )


def path_segments(path: Column) -> Column:
    """Non-empty segments of a URL path."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def segments_path(segments: Column) -> Column:
    """Segments joined to a rooted URL path; none give '/'."""
    return F.concat(F.lit("/"), F.coalesce(F.array_join(segments, "/"), F.lit("")))


def display_name(slug: Column) -> Column:
    """Title of a slug: every letter after a non-letter is upper case, all others lower."""
    words = F.split(F.lower(F.replace(slug, F.lit("-"), F.lit(" "))), r"(?<!\p{L})(?=\p{L})")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), "")


def classify_error(message: Column) -> Column:
    """Struct (message, next_steps) of the first service the error text names."""
    result = None
    for names, text, steps in ERROR_HELP:
        value = F.struct(F.lit(text).alias("message"), F.array(*[F.lit(s) for s in steps]).alias("next_steps"))
        if not names:
            return result.otherwise(value)
        hit = message.contains(names[0])
        for name in names[1:]:
            hit = hit | message.contains(name)
        result = F.when(hit, value) if result is None else result.when(hit, value)


def extract_build_log(message: Column, marker: str = BUILD_LOG_MARKER) -> Column:
    """Struct (build_logs, build_state) of the text after the first marker, up to a second one."""
    found = message.contains(marker)
    return F.struct(
        F.when(found, python_strip(F.split_part(message, F.lit(marker), F.lit(2)))).alias("build_logs"),
        F.when(found, "ERROR").alias("build_state"),
    )


def error_lines(logs: Column) -> Column:
    """Lines that speak of an error or failure."""

    def speaks_of_failure(line: Column) -> Column:
        low = F.lower(line)
        return reduce(lambda a, b: a | b, [low.contains(word) for word in ERROR_WORDS])

    return F.filter(F.split(logs, "\n"), speaks_of_failure)


def build_failure_report(state: Column, error: Column, lines: Column, has_logs: Column) -> Column:
    """Multi-line report: head, then the first error lines and how many were left out.

    ``lines`` are the error lines of the logs, best computed beforehand.
    """
    none = F.array().cast("array<string>")
    shown = F.transform(F.slice(lines, 1, TOP_ERRORS), lambda line: F.concat(F.lit("  "), line))
    left_out = F.size(lines) - TOP_ERRORS
    more = F.when(
        left_out > 0, F.array(F.concat(F.lit("  ... and "), left_out.cast("string"), F.lit(" more errors")))
    ).otherwise(none)
    head = F.array(
        F.concat(F.lit("Vercel build failed (state: "), F.coalesce(state, F.lit("UNKNOWN")), F.lit(")")),
        F.concat(F.lit("Error: "), error),
    )
    body = F.when(has_logs, F.concat(F.array(F.lit("\nBuild Errors:")), shown, more)).otherwise(none)
    return F.array_join(F.concat(head, body), "\n")


def build_outcome(ready_state: Column) -> Column:
    """Struct (finished, success, error) of one polled state."""
    failure = F.create_map(*[F.lit(x) for pair in BUILD_FAILURES.items() for x in pair])
    error = F.try_element_at(failure, F.coalesce(ready_state, F.lit("")))
    success = F.when(ready_state == "READY", True).when(error.isNotNull(), False)
    return F.struct(success.isNotNull().alias("finished"), success.alias("success"), error.alias("error"))


def archived_name(name: Column) -> Column:
    return F.when(name.startswith(ARCHIVE_PREFIX), name).otherwise(F.concat(F.lit(ARCHIVE_PREFIX), name))


def key_format(key: Column) -> Column:
    return (
        F.when(F.coalesce(key, F.lit("")) == "", "missing")
        .when(~key.startswith(KEY_PREFIX), "invalid_format")
        .otherwise("candidate")
    )


def masked_key(key: Column) -> Column:
    """First ten and last four characters of a key; 'None' for no key."""
    return F.when(F.coalesce(key, F.lit("")) == "", "None").otherwise(
        F.concat(F.left(key, F.lit(10)), F.lit("..."), F.right(key, F.lit(4)))
    )


def staging_url(slug: Column) -> Column:
    return F.concat(F.lit("https://"), slug, F.lit(PREVIEW_DOMAIN))


def production_url(slug: Column, domain: str = SITE_DOMAIN) -> Column:
    return F.concat(F.lit("https://"), slug, F.lit(f".{domain}"))


def backup_name(slug: Column, generated_at: Column) -> Column:
    stamp = F.date_format(generated_at, "yyyyMMdd-HHmmss")
    return F.concat(F.lit("projects/"), slug, F.lit("/generation-"), stamp, F.lit(".zip"))


def backup_url(name: Column, bucket: str = BACKUP_BUCKET) -> Column:
    return F.concat(F.lit(f"gs://{bucket}/"), name)
