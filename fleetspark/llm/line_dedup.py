"""Fuzzy line deduplication: MinHash bands, sketches, exact Jaccard, union-find.

A line is what stands between line ends, without white space at its ends; blank lines stay as
they are.  Its set holds every run of five characters, lower-cased; a shorter line is one run.
Lines that share a band of three MinHash values are candidates.  The values are of runs of nine
characters, of which unlike lines share hardly any.  Of longer lines some sixty runs are sampled by hash, the same
ones of similar lines.  A pair that differs by scattered letters so that five-character runs agree to 4/5 agrees
in its longer runs to 2/3, and shares one of twenty-four bands with probability 0.99 (simulated with the sample);
where the difference is in one place, both agree more alike.  Small buckets are compared pair by pair.  In
larger ones every line is first compared with one of them, another one for each quarter of the bands; only
buckets that this leaves in more than one component are compared as a whole, in blocks.  Sketches, bitmaps of a
sample of the runs, leave out pairs far from 4/5 before any text is fetched; the others are compared by all of
their runs.  Lines with a Jaccard similarity of 4/5 are linked, and of each component only the first line stays.

All of it is DataFrame operations.  What runs over every character is exploded to rows, which Spark
compiles.  A table that is written on the way is deleted when nothing reads it any more.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm import textops
from fleetspark.llm.components import components
from fleetspark.llm.set_join import _dealt
from fleetspark.llm.tables import SPACES, discard, once, row_key, small, written

#: Characters of a shingle, and of the runs that signatures are made of.
SHINGLE, SIGNED = 5, 9
#: Bands, MinHash values in each, and values in all: the first bands share none, each later one has values of three of them.
BANDS, ROWS, VALUES = 24, 3, 24
#: Parts in which bands are joined, one after another, so that only a part of them is shuffled at a time.
PARTS = 3
NUMERATOR, DENOMINATOR = 4, 5
#: Buckets of up to so many lines are compared pair by pair.
SMALL = 8
#: Lines of a large bucket that are heads of some of a crowd's bands.
HEADS = 4
#: Lines of larger buckets compared together.
CHUNK = 512
#: Characters of a window by which a line is seen to repeat itself.
WINDOW = 20
#: Runs that a signature is made of, on average; lines that repeat themselves are signed by all.
SAMPLED = 64
#: Sampled runs by which pairs far from the threshold are told, and the words of bits they are marked in.
TOLD, WORDS = 128, 8
#: Characters of a pair of lines beyond which its sets are not made as arrays.
LONG = 1 << 15
LOW = (1 << 32) - 1
BASE = 0x9E3779B97F4A7C15


def _lines(docs: DataFrame) -> DataFrame:
    """rk, doc_id, pos, nth (among lines with text), line, lid; a null text has no line."""
    rows = docs.select(row_key(docs).alias("rk"), "doc_id", F.split("text", "\n").alias("ls"))
    used = F.filter(F.transform("ls", lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(SPACES)).alias("line"))), lambda s: F.length(s["line"]) > 0)
    out = rows.select("rk", "doc_id", F.posexplode(used).alias("nth", "s"))
    return out.select("rk", "doc_id", F.col("s.pos").alias("pos"), "nth", F.col("s.line").alias("line"), F.xxhash64("s.line").alias("lid"))


def _multipliers() -> np.ndarray:
    return textops.mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def _band_values() -> list[list[int]]:
    """The MinHash values of each band."""
    whole = VALUES // ROWS
    # The bands past the first ones take one value each of three first ones, at other distances in each round.
    later = lambda k, i: (k + i * (whole // ROWS + k // whole - 1)) % whole * ROWS + i
    return [[(k * ROWS + i) if k < whole else later(k, i) for i in range(ROWS)] for k in range(BANDS)]


def _windows(c: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` numbers, put together from runs of half the width."""
    if len(c) < width:
        return np.zeros(0, np.uint64)
    if width == 1:
        return c
    half = width // 2
    h = _windows(c, half)
    h = h[: len(h) - half] * np.uint64(pow(BASE, half, 1 << 64)) + h[half:]
    return h[:-1] * np.uint64(BASE) + c[width - 1 :] if width % 2 else h


def shingles(lines: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of ``width`` characters of each line, their number per line); lines have no
    line ends and are not empty.  A shorter line is one run of what it has.  The operator's sets in
    numpy, for comparison; it takes them from DataFrame operations itself."""
    characters = np.frombuffer("\n".join(lines).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    cuts = np.flatnonzero(characters == 10)
    starts, sizes = np.append(0, cuts + 1), np.diff(cuts, prepend=-1, append=len(characters)) - 1
    c = characters.astype(np.uint64) + np.uint64(1)
    h = _windows(c, width)
    whole = np.ones(len(h), bool)
    for k in range(width):  # runs over a line end are none
        at = cuts - k
        whole[at[(at >= 0) & (at < len(h))]] = False
    counts = np.maximum(sizes - width + 1, 1)
    out, long = np.empty(int(counts.sum()), np.uint64), np.ones(int(counts.sum()), bool)
    short = np.flatnonzero(sizes < width)
    if len(short):
        places = (np.cumsum(counts) - counts)[short]
        long[places] = False
        padded = np.zeros(len(short), np.uint64)
        for k in range(width):
            inside = k < sizes[short]
            padded *= np.uint64(BASE)
            padded[inside] += c[starts[short][inside] + k]
        out[places] = padded
    out[long] = h[whole]
    return textops.mix(out), counts


def _hashes(lines: DataFrame, width: int, under: Column) -> DataFrame:
    """(lid, under, h): hashes of the runs of ``width`` UTF-16 units of each line, lower-cased; a shorter line is one run.

    Kept are those whose lower half is under the given number, of n, the runs' number, and repeats.
    """
    coded = once(lines.select("lid", F.encode(F.lower("line"), "UTF-16BE").alias("b"), "repeats"), n=F.greatest(F.lit(1), F.expr(f"octet_length(b) div 2 - {width - 1}")))
    runs = coded.select("lid", "b", under.alias("under"), F.explode(F.sequence(F.lit(1), F.expr("cast(2 * n - 1 AS INT)"), F.lit(2))).alias("at"))
    h = runs.select("lid", "under", F.expr(f"xxhash64(substring(b, at, {2 * width}))").alias("h"))
    return h.where(F.col("h").bitwiseAND(F.lit(LOW)) < F.col("under"))


def _bands(lines: DataFrame) -> DataFrame:
    """(lid, keys): the bands of MinHash values of each distinct line."""
    multipliers = [int(m >> np.uint64(33)) | 1 for m in _multipliers()]
    h = _hashes(lines, SIGNED, F.expr(f"if(repeats, {LOW + 1}L, {SAMPLED << 32}L div n)")).select("lid", F.col("h").bitwiseAND(F.lit(LOW)).alias("h"))
    least = h.groupBy("lid").agg(*[F.min((F.col("h") * F.lit(m)).bitwiseAND(F.lit(LOW))).alias(f"m{k}") for k, m in enumerate(multipliers)])
    keys = [F.xxhash64(F.lit(k), *[f"m{i}" for i in band]) for k, band in enumerate(_band_values())]
    return least.select("lid", F.array(*keys).alias("keys"))


def _repeats() -> Column:
    """Whether a line's first or middle window stands in it again: it may have far fewer runs than characters."""
    again = lambda at: f"contains(substring(line, {at} + 1), substring(line, {at}, {WINDOW}))"
    return F.expr(f"{again(1)} OR {again('length(line) div 2')}")


def _buckets(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(key, lid, size, head): the lines of every band that several share; head, of larger buckets, is one of them."""
    signed = written(_bands(lines.select("lid", "line").withColumn("repeats", _repeats())), spark, "bands")
    parts = []
    for part in range(PARTS):
        keys = signed.select("lid", F.explode(F.filter("keys", lambda _, i: i % PARTS == part)).alias("key"))  # noqa: B023
        shared = written(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), spark, "shared")
        parts.append(written(keys.join(small(shared, shared.count(), 64), "key").select("key", "lid", "size"), spark, "cells"))
        discard(spark, shared)
    discard(spark, signed)
    cells = reduce(DataFrame.unionByName, parts)
    large = cells.where(F.col("size") > SMALL)
    heads = large.groupBy("key").agg(F.min_by("lid", F.xxhash64("lid", F.pmod("key", F.lit(HEADS)))).alias("head"))
    return cells.where(F.col("size") <= SMALL).withColumn("head", F.lit(None).cast("long")).unionByName(large.join(heads, "key"))


def _pairs(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b) to compare first: all of small buckets, each line with its head in larger ones."""
    few = buckets.where(F.col("size") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("lid")).alias("l"))
    two = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, SMALL), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    heads = buckets.where((F.col("size") > SMALL) & (F.col("lid") != F.col("head"))).select(F.least("head", "lid").alias("a"), F.greatest("head", "lid").alias("b"))
    return few.select(F.inline(two)).unionByName(heads).distinct()


def _sketches(texts: DataFrame) -> DataFrame:
    """(lid, under, bits, w0, w1, ...): a sample of a line's runs, marked in words of 64 bits, and the number of bits marked.

    Sampled are runs whose hash is in its lower half less than ``under``, so that the same run is in the samples of two lines or, at the lower rate, in neither.
    """
    h = _hashes(texts.withColumn("repeats", _repeats()), SHINGLE, F.expr(f"if(repeats, {LOW + 1}L, least({LOW + 1}L, {TOLD << 32}L div n))"))
    marks = h.select("lid", "under", F.expr(f"cast(shiftrightunsigned(h, 32) & {64 * WORDS - 1} AS INT)").alias("at"))
    words = marks.groupBy("lid", "under").agg(*[F.bit_or(F.expr(f"if(at div 64 = {w}, shiftleft(1L, at % 64), 0L)")).alias(f"w{w}") for w in range(WORDS)])
    return words.withColumn("bits", F.expr(" + ".join(f"bit_count(w{w})" for w in range(WORDS))))


def _like(left: str, right: str) -> Column:
    """Whether the sketches of two lines leave it open that their sets agree to the threshold.

    Of the runs of two lines at 4/5, 4/9 of both numbers together are shared.  Sketches of as many
    bits as are asked for show 2/5 or more, being over four standard deviations off; smaller ones tell nothing.
    """
    x, y = lambda c: f"{left}.{c}", lambda c: f"{right}.{c}"
    shared = " + ".join(f"bit_count({x(f'w{w}')} & {y(f'w{w}')})" for w in range(WORDS))
    rate = f"least({x('under')}, {y('under')})"
    both = f"({rate} / {x('under')} * {x('bits')} + {rate} / {y('under')} * {y('bits')})"
    unknown = " OR ".join(f"({c('under')} <= {LOW} AND {c('bits')} < {TOLD // 2})" for c in (x, y))
    return F.expr(f"5 * ({shared}) >= 2 * {both} OR {unknown}")


def _in_arrays(pairs: DataFrame) -> DataFrame:
    """(a, b, shared, both): runs in both sets, and sizes of both, of the pairs' lines l and r."""
    # The text is a variable of the outer function: as a column it would be copied for every run.
    runs = lambda c: F.expr(f"flatten(transform(array({c}), t -> transform(sequence(1, greatest(1, octet_length(t) - {4 * SHINGLE - 1}), 4), i -> xxhash64(substring(t, i, {4 * SHINGLE})))))")
    counts = once(once(pairs, x=runs("l"), y=runs("r")), shared=F.size(F.array_intersect("x", "y")), either=F.size(F.array_union("x", "y")))
    return counts.select("a", "b", "shared", (F.col("shared") + F.col("either")).alias("both"))


def _in_rows(pairs: DataFrame) -> DataFrame:
    """The same of long lines, whose runs are rows of their own: no task holds a whole set."""
    side = lambda n, c: F.struct(F.lit(n).alias("side"), F.col(c).alias("line"))
    places = F.expr(f"sequence(1, greatest(1, octet_length(line) - {4 * SHINGLE - 1}), 4)")
    runs = pairs.select("a", "b", F.inline(F.array(side(1, "l"), side(2, "r")))).select("a", "b", "side", "line", F.explode(places).alias("at"))
    sets = runs.select("a", "b", "side", F.expr(f"xxhash64(substring(line, at, {4 * SHINGLE}))").alias("h")).groupBy("a", "b", "h").agg(F.bit_or("side").alias("sides"))
    return sets.groupBy("a", "b").agg(F.count_if(F.col("sides") == 3).alias("shared"), F.sum(F.bit_count("sides")).alias("both"))


def _verified(spark: SparkSession, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of lines whose sets have a Jaccard similarity of the threshold or more."""
    left, right = texts.select(F.col("lid").alias("a"), F.col("line").alias("left")), texts.select(F.col("lid").alias("b"), F.col("line").alias("right"))
    both = written(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right"), spark, "pair-texts")
    long = F.length("left") + F.length("right") > LONG
    n_long, characters = both.where(long).agg(F.count("*"), F.sum(F.length("left") + F.length("right"))).first()
    lower = lambda rows: once(rows, l=F.encode(F.lower("left"), "UTF-32"), r=F.encode(F.lower("right"), "UTF-32")).select("a", "b", "l", "r")
    counts = _in_arrays(lower(both.where(~long).repartition("a", "b")))
    if n_long:
        counts = counts.unionByName(_in_rows(lower(both.where(long).repartition(max(1, characters >> 21), "a", "b"))))
    edges = written(counts.where((NUMERATOR + DENOMINATOR) * F.col("shared") >= NUMERATOR * F.col("both")).select("a", "b"), spark, "line-edges")
    discard(spark, both)
    return edges


def _near(pairs: DataFrame, sketches: DataFrame, rows: int) -> DataFrame:
    """The pairs (a, b) that sketches do not tell apart."""
    side = lambda c: small(sketches.select(F.col("lid").alias(c), F.struct(*[x for x in sketches.columns if x != "lid"]).alias(f"s{c}")), rows, 160)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_like("sa", "sb")).select("a", "b")


def _open(spark: SparkSession, buckets: DataFrame, roots: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) within larger buckets that have lines of several components, all of them looked at by their sketches.

    A bucket is dealt to blocks of at most ``CHUNK`` lines on average, and its
    lines to all pairs of their block; no task has a whole crowd.
    """
    large = buckets.where(F.col("size") > SMALL).select("key", "lid")
    named = large.join(roots, large["lid"] == roots["node"], "left").select("key", "lid", F.coalesce("root", "lid").alias("root"))
    unsettled = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / CHUNK).alias("chunks")).where("lo < hi")
    members = named.join(unsettled.select("key", "chunks"), "key").join(sketches, "lid")
    block, rows = ["key", "c1", "c2"], written(_dealt(members, "key", "chunks", "lid"), spark, "blocks")
    row = F.struct(*[c for c in rows.columns if c not in (*block, "chunk")])
    left, right = rows.where("chunk = c1").select(*block, row.alias("a")), rows.where("chunk = c2").select(*block, row.alias("b"))
    # What is linked already need not be compared.
    close = left.join(right, block).where("a.root != b.root AND (c1 < c2 OR a.lid < b.lid)").where(_like("a", "b"))
    pairs = written(close.select(F.least("a.lid", "b.lid").alias("a"), F.greatest("a.lid", "b.lid").alias("b")).distinct(), spark, "line-pairs")
    discard(spark, rows)
    return pairs


def near_lines(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(node, root) of the lines (lid, line) that have a near-duplicate of another text."""
    buckets = _buckets(spark, lines)
    wanted = written(buckets.select("lid").distinct(), spark, "wanted")
    n = wanted.count()
    texts = written(lines.select("lid", "line").join(small(wanted, n, 64), "lid", "left_semi").dropDuplicates(["lid"]), spark, "line-texts")
    sketches = written(_sketches(texts), spark, "sketches")
    pairs = written(_near(_pairs(buckets), sketches, n), spark, "line-pairs")
    edges = _verified(spark, pairs, texts)
    roots = components(edges)
    unsettled = _open(spark, buckets, roots, sketches)
    discard(spark, buckets, wanted, sketches, pairs)
    more = _verified(spark, unsettled, texts)
    if not more.isEmpty():
        again = components(edges.unionByName(more))
        discard(spark, roots)
        roots = again
    discard(spark, texts, edges, unsettled, more)
    return roots


def marked(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with text less its repeated lines, ``n_lines`` (lines with text) and ``n_kept``.

    Of every component of equal or similar lines the first by (doc_id, row, place) stays, nulls
    last.  A null text stays null.  Of rows equal in every column one keeps its lines and the
    others lose them all.  Columns called n_lines or n_kept give way to the new ones.  Lines and
    shingles are named by 64-bit hashes: among 10^9 distinct lines an accidental pair is expected
    once in some forty runs.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_kept")])
    out = _deduplicated(spark, docs)
    return out.withColumnsRenamed({"__n_lines": "n_lines", "__n_kept": "n_kept"})


def _deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    every = written(_lines(docs), spark, "lines")
    lines = every.drop("line")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk", "pos")
    firsts = lines.groupBy("lid").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    roots = near_lines(spark, every.select("lid", "line"))
    named = firsts.join(roots, firsts["lid"] == roots["node"], "left").where("n > 1 OR root IS NOT NULL").select("lid", "first", F.coalesce("root", "lid").alias("root"))
    named = written(named, spark, "named-lines")
    keep = named.groupBy("root").agg(F.min("first").alias("keep"))
    kept = named.join(keep, "root").select("lid", F.col("keep.rk").alias("keep_rk"), F.col("keep.pos").alias("keep_pos"))
    lost = lines.join(kept, "lid").where((F.col("rk") != F.col("keep_rk")) | (F.col("pos") != F.col("keep_pos")))
    drops = written(lost.groupBy("rk").agg(F.collect_set("pos").alias("__drops")), spark, "drops")
    copies = written(lines.where("nth = 0").groupBy("rk").agg(F.count("*").alias("__copies")).where("__copies > 1"), spark, "copies")
    discard(spark, every, named, roots)
    return _rebuilt(docs, drops, copies)


def _rebuilt(docs: DataFrame, drops: DataFrame, copies: DataFrame) -> DataFrame:
    names = docs.columns
    keyed = docs.withColumn("__rk", row_key(docs))
    n_drops, bytes_each = drops.agg(F.count("*"), F.avg(F.size("__drops") * 4 + 24)).first()
    n_copies = copies.count()
    if n_copies:
        repeated = small(copies.withColumnRenamed("rk", "__rk"), n_copies, 40)
        once_each = keyed.join(repeated, "__rk").dropDuplicates(["__rk"])
        nth = once_each.withColumn("__nth", F.explode(F.expr("sequence(1, cast(__copies AS INT))"))).drop("__copies")
        keyed = keyed.join(repeated, "__rk", "left_anti").withColumn("__nth", F.lit(1)).unionByName(nth)
    else:
        keyed = keyed.withColumn("__nth", F.lit(1))
    joined = keyed.join(small(drops.withColumnRenamed("rk", "__rk"), n_drops, int(bytes_each or 0) + 1), "__rk", "left")
    text = lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0
    split = once(joined, __ls=F.split("text", "\n"))
    split = once(split, __no=F.when(F.col("__nth") > 1, F.transform(F.filter(F.transform("__ls", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: text(s["x"])), lambda s: s["i"])).otherwise(F.coalesce("__drops", F.array().cast("array<int>"))))
    split = once(split, __yes=F.array_except(F.sequence(F.lit(0), F.size("__ls") - 1), F.col("__no")))
    new = F.when(F.size("__no") == 0, F.col("text")).otherwise(F.array_join(F.transform("__yes", lambda i: F.get("__ls", i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter("__ls", text)))
    out = once(split, __n_lines=n_lines.cast("long"), __new=new)
    return out.select(*[F.col("__new").alias("text") if c == "text" else F.col(f"`{c}`") for c in names], "__n_lines", (F.col("__n_lines") - F.size("__no")).alias("__n_kept"))


def keep_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with each line once; documents that had lines and lose them all go.  An n_chars is counted anew."""
    out = _deduplicated(spark, docs).where("__n_lines = 0 OR __n_kept > 0")
    recount = lambda c: F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`")
    return out.select(*[recount(c) for c in docs.columns])


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return marked(spark, docs).select("doc_id", "n_lines", "n_kept", F.md5("text").alias("text_md5"))
