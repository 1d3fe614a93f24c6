"""URL filter: host and path rules, else a ratio of two smoothed variable-order character models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm.tables import small, written

# The rules of the query (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Longest context in characters, and the weight of the next shorter context's estimate.
ORDER = 4
PRIOR = 2.0
#: Share of accepted URLs the limit may cost.
MAX_LOSS = 0.01
_START, _END = "\x02", "\x03"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
_REST = r"(?s)^.*?://[^/?#]*(.*)$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a url without ``://``."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, _URL, 1), UPPER, LOWER), F.regexp_extract(text, _URL, 2)


def scored_text(url: Column, host: Column) -> Column:
    """What the models read: all that follows ``://``, its host lower-cased, or the whole text of a url
    without; digits count as one character."""
    text = F.coalesce(url, F.lit(""))
    whole = F.when(F.contains(text, F.lit("://")), F.concat(host, F.regexp_extract(text, _REST, 1))).otherwise(text)
    return F.translate(whole, "123456789", "000000000")


def rule_of(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest fitting rule, of equals the first; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(RULES if rules is None else rules, key=lambda r: -len(r[1] + r[2]))
    for decision, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def model(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, llr: for each character after its ``order`` predecessors the log ratio of its
    probability among accepted and among rejected texts, in millionths.

    ``texts`` has text, accepted and rejected (numbers of URLs; 0 and 0 where undecided).  The
    estimate of a context mixes its counts with that of the context one character shorter.
    """
    padded = F.concat(F.lit(_START * order), "text", F.lit(_END))
    grams = (
        texts.select(F.explode(grams_of(padded, order)).alias("gram"), "accepted", "rejected")
        .groupBy("gram").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
    )
    total = grams.agg(F.sum("a"), F.sum("r"), F.countDistinct(F.substring("gram", order + 1, 1))).first()
    shorter = None
    for k in range(order + 1):
        events = grams if k == order else grams.groupBy(F.expr(f"right(gram, {k + 1})").alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        if k == 0:
            size = total[2] or 1
            shorter = events.select(
                F.col("gram").alias("tail"), ((F.col("a") + 1) / ((total[0] or 0) + size)).alias("pa"), ((F.col("r") + 1) / ((total[1] or 0) + size)).alias("pr")
            )
            continue
        events = events.withColumn("context", F.expr(f"left(gram, {k})")).withColumn("tail", F.expr(f"right(gram, {k})"))
        contexts = events.groupBy("context").agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        joined = events.join(contexts, "context").join(shorter, "tail")
        mixed = lambda n, c, p: (F.col(n) + PRIOR * F.col(p)) / (F.col(c) + PRIOR)
        shorter = joined.select(F.col("gram").alias("tail"), mixed("a", "ca", "pa").alias("pa"), mixed("r", "cr", "pr").alias("pr"))
    return shorter.select(F.col("tail").alias("gram"), F.round(F.log(F.col("pa") / F.col("pr")) * 1e6).cast("long").alias("llr"))


def grams_of(padded: Column, order: int) -> Column:
    """Every run of ``order`` + 1 characters, in one pass over the text."""
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order + 1}}})).")  , F.lit(1))


def judged(spark: SparkSession, pages: DataFrame, rules=None, order: int = ORDER, max_loss: float = MAX_LOSS) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio (thousandths of nats per character, higher: more like accepted).

    The models learn from all URLs that a rule decides.  An undecided URL is blocked if its
    ratio is under the limit: the ``max_loss`` quantile of the accepted URLs, 0 at most.  Without
    accepted or without rejected URLs nothing undecided is blocked.  Query strings, fragments and
    urls without ``://`` are read too.  Rows with the same id, and null ids, stay rows of their own.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), scored_text(F.col("url"), host).alias("text"))
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("*", rule.alias("rule"), decided.alias("decided"))
    texts = parsed.groupBy("text").agg(F.count_if(F.col("decided") == "allow").alias("accepted"), F.count_if(F.col("decided") == "block").alias("rejected"))
    padded = F.concat(F.lit(_START * order), "text", F.lit(_END))
    # As many grams as the alphabet makes; a table known to be small is sent to the URLs, whose starts are all alike.
    learned = written(model(texts, order), spark, "url-model")
    scored = written(
        texts.select("text", "accepted", "rejected", F.explode(grams_of(padded, order)).alias("gram")).join(small(learned, learned.count(), 100), "gram")
        .groupBy("text").agg(F.first("accepted").alias("accepted"), F.first("rejected").alias("rejected"), F.round(F.sum("llr") / (1000.0 * F.count("*"))).cast("long").alias("ratio")),
        spark, "url-ratios",
    )
    # Ratios are whole thousandths, so the exact quantile keeps few distinct values.
    limit, n_accepted, n_rejected = (
        scored.where("accepted > 0 OR rejected > 0")
        .agg(F.expr(f"percentile(CASE WHEN accepted > 0 THEN ratio END, {max_loss}D, CASE WHEN accepted > 0 THEN accepted ELSE 0 END)"), F.sum("accepted"), F.sum("rejected")).first()
    )
    limit = min(0.0, limit) if n_accepted and n_rejected else float("-inf")
    verdict = F.coalesce("decided", F.when(F.col("ratio") < limit, "block").otherwise("allow"))
    return parsed.join(scored.select("text", "ratio"), "text", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "ratio")


def op10(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judged(spark, pages)


def _oracle() -> str:
    order = ORDER
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in ordered) + " END"
    decided = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{d}'" for d, h, p in ordered) + " END"
    levels = ["p0 AS (SELECT gram, (a + 1) / (na + size) AS pa, (r + 1) / (nr + size) AS pr FROM (SELECT right(gram, 1) AS gram, sum(a) AS a, sum(r) AS r FROM g GROUP BY 1), "
              f"(SELECT sum(a) AS na, sum(r) AS nr, count(DISTINCT right(gram, 1)) AS size FROM g))"]
    for k in range(1, order + 1):
        levels.append(f"e{k} AS (SELECT right(gram, {k + 1}) AS gram, sum(a) AS a, sum(r) AS r FROM g GROUP BY 1)")
        levels.append(f"c{k} AS (SELECT left(gram, {k}) AS context, sum(a) AS ca, sum(r) AS cr FROM e{k} GROUP BY 1)")
        levels.append(
            f"p{k} AS (SELECT e{k}.gram, (e{k}.a + {PRIOR} * pa) / (ca + {PRIOR}) AS pa, (e{k}.r + {PRIOR} * pr) / (cr + {PRIOR}) AS pr "
            f"FROM e{k} JOIN c{k} ON context = left(e{k}.gram, {k}) JOIN p{k - 1} AS s ON s.gram = right(e{k}.gram, {k}))"
        )
    upper = f"translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), '{UPPER}', '{LOWER}')"
    return f"""
WITH u AS (SELECT page_id, {upper} AS host, regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path, coalesce(url, '') AS url FROM pages),
d AS (SELECT *, {rule} AS rule, {decided} AS decided,
  translate(CASE WHEN contains(url, '://') THEN host || regexp_extract(url, '{_REST}', 1) ELSE url END, '123456789', '000000000') AS text FROM u),
t AS (SELECT text, count(*) FILTER (decided = 'allow') AS accepted, count(*) FILTER (decided = 'block') AS rejected FROM d GROUP BY text),
x AS (SELECT text, accepted, rejected, unnest(list_transform(range(1, length(text) + 2), lambda i: substr(repeat(chr(2), {order}) || text || chr(3), i, {order + 1}))) AS gram FROM t),
g AS (SELECT gram, sum(accepted)::DOUBLE AS a, sum(rejected)::DOUBLE AS r FROM x GROUP BY gram),
{", ".join(levels)},
m AS (SELECT gram, CAST(round(ln(pa / pr) * 1e6) AS BIGINT) AS llr FROM p{order}),
s AS (SELECT text, any_value(accepted) AS accepted, any_value(rejected) AS rejected, CAST(round(sum(llr) / (1000.0 * count(*))) AS BIGINT) AS ratio FROM x JOIN m USING (gram) GROUP BY text),
l AS (SELECT CASE WHEN count(*) FILTER (decided = 'allow') > 0 AND count(*) FILTER (decided = 'block') > 0
  THEN least(0.0, quantile_cont(ratio, {MAX_LOSS}) FILTER (decided = 'allow')) ELSE '-infinity'::DOUBLE END AS lim FROM d JOIN s USING (text))
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN ratio < lim THEN 'block' ELSE 'allow' END) AS verdict, ratio
FROM d JOIN s USING (text), l
"""


ORACLE = _oracle()
