"""Quality rules as a bitmask ledger: every rule once, failures as bits, policies and ablations on the bits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.tables import SPACES, once

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 3

#: Bit, name and condition of failure over the measurements.
RULES = [
    ("too_few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("too_many_words", "n_words > 100000"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("upper_case", "2 * n_upper > word_chars"),
]
#: Policies by version: the bits that reject.
POLICIES = {1: ["too_few_words", "repeated_words"], 2: [name for name, _ in RULES]}
CURRENT = 2


def mask_of(names: list[str]) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in names)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every whole text; a null text has none of anything.

    Windows of three words are compared by 64-bit hashes of hashes within one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = " " * len(SPACES)
    base = once(docs.select("doc_id", text.alias("_t")), _flat=F.translate("_t", SPACES, blank), _lines=F.split("_t", "\n"))
    no_blank = F.array_remove(F.split("_flat", " "), "")
    with_words = once(
        base, _w=F.transform(no_blank, lambda w: F.xxhash64(w)), _solid=F.translate("_t", SPACES, ""),
        _used=F.filter("_lines", lambda line: F.length(F.translate(line, SPACES, "")) > 0),
    )
    last = F.size("_w") - REPEAT_WINDOW
    window = lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(REPEAT_WINDOW)])
    grams = once(with_words, _g=F.when(last < 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window)))
    ordered = once(grams, _s=F.sort_array("_g"))
    # Most texts repeat nothing and skip the rest.
    twice = once(ordered, _twice=F.size(F.array_distinct("_s")) < F.size("_s"))
    placed = once(twice, _p=F.when(F.col("_twice"), F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get("_p", j - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get("_p", j + 1)["g"] == x["g"], F.lit(False))
    places = once(placed, _at=F.sort_array(F.transform(F.filter("_p", same), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_at", lambda p, j: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get("_at", j + 1) - p, F.lit(REPEAT_WINDOW)))), F.lit(0), lambda a, b: a + b)
    count = lambda c: F.length(c).cast("long")
    return once(
        places,
        n_words=F.size("_w").cast("long"), word_chars=count("_solid"), n_symbols=count("_t") - count(F.translate("_t", SYMBOLS, "")),
        n_dup_lines=(F.size("_used") - F.size(F.array_distinct("_used"))).cast("long"), n_lines=F.size("_used").cast("long"),
        n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long"), n_upper=count("_t") - count(F.regexp_replace("_t", "[A-Z]", "")),
    ).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements with ``failed``: bit i is set where rule i of ``RULES`` fails.  One row per
    document row, whatever its other columns; null texts fail as empty ones."""
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, condition) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured(docs).withColumn("failed", failed)


def verdicts(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """A ledger with ``kept`` under one policy; no rule runs again."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[version]))) == 0)


def ablations(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those rejected by it alone, which come back without it."""
    mask = mask_of(POLICIES[version])
    seen = rows.select(F.col("failed").bitwiseAND(F.lit(mask)).alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if mask >> i & 1]
    return (
        seen.select("f", "n", F.inline(F.array(*rules))).where(F.col("f").bitwiseAND(F.col("bit")) != 0)
        .groupBy("rule").agg(F.sum("n").alias("n_failed"), F.coalesce(F.sum(F.when(F.col("f") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"))
    )


def op9(docs: DataFrame) -> DataFrame:
    base = mask_of(POLICIES[1])
    out = verdicts(ledger(docs))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept", F.col("failed").alias("failed_rules"),
    )


_WORD = r"[^\x20\x09-\x0D]+"
_SYMBOL_CLASS = "[#*$%&|<>]"
_BITS = " + ".join(f"CASE WHEN {condition} THEN {1 << i} ELSE 0 END" for i, (_, condition) in enumerate(RULES))

ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
p AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS g FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM h, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
u AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '{_WORD}') GROUP BY r),
m AS (SELECT d.r, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '{_SYMBOL_CLASS}', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper
  FROM d JOIN w USING (r) LEFT JOIN u USING (r) LEFT JOIN c USING (r)),
f AS (SELECT *, CAST({_BITS} AS BIGINT) AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (failed & {mask_of(POLICIES[1])}) <> 0 AS base_failed, (failed & {mask_of(POLICIES[CURRENT])}) = 0 AS kept, failed AS failed_rules
FROM f
"""
