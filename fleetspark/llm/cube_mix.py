"""Mixing sources to target weights by the cube method.

Every document of a source is wanted the same number of times on average: target / size of its
source.  The whole part of that is certain; the fraction is an inclusion probability.  The flight
moves three undecided documents at a time along a direction in which neither the tokens nor the
number of documents of the sample change, until one of them is decided.  Sources are cut into
chunks by a hash; each chunk flies until ``LEFT`` of its documents are undecided, and these fly
again together, until one chunk a source is left.  Its last documents are the landing problem:
of all their subsets the one closest to the expected totals is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspark.llm import textops
from fleetspark.llm.tables import small, written

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all sizes that the mix takes, and how often it may take one source at most.
BUDGET, MOST = 1.5, 2.0
#: Undecided documents a chunk leaves; landing compares 2^LEFT subsets.
LEFT = 12
CHUNK = 8192
#: How many average documents a missed document weighs against missed tokens.
DOCUMENT_WEIGHT = 0.125
EPSILON = 1e-9
#: Largest documents of a chunk, which fly first, against all others at once.
HEAVY = 64

_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of every row: the number of runs of other bytes than blanks (null text: 0)."""

    def counted(batches):
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            for first, data, offsets in textops.utf8_slices(batch.column("text")):
                blank = _SPACE[data]
                begins = ~blank
                begins[1:] &= blank[:-1]
                starts = offsets[:-1][offsets[:-1] < offsets[1:]]
                begins[starts] = ~blank[starts]
                size[first : first + len(offsets) - 1] = np.diff(np.append(0, np.cumsum(begins, dtype=np.int64))[offsets])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(size)], ["doc_id", "source", "size"])

    kinds = docs.select("doc_id", "source").schema
    return docs.select("doc_id", "source", "text").mapInArrow(counted, f"doc_id {kinds['doc_id'].dataType.simpleString()}, source {kinds['source'].dataType.simpleString()}, size long")


def _numbered(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, 0 for the first by name, null last, without sorting them in one task."""
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    at = written(ranged.withColumn("_id", F.monotonically_increasing_id()), spark, "sources")
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    parts = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row per partition
    offsets = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return at.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("place", F.col("_before") + within).drop("_part", "_before", "_id")


def targets(spark: SparkSession, sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size) with place, weight and target.

    ``budget`` times all sizes is shared by weight; a target stops at ``most`` times its source's size
    and the excess is shared again among the others, until none is above.  Sources without tokens get 0.
    """
    weighed = written(
        _numbered(spark, sources).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("ceiling", F.col("source_size") * float(most)), spark, "weights",
    )
    total = budget * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    share, open_before = 0.0, None
    # The share per weight rises to a fixed point: every round fills the sources that the last one put above
    # their ceiling.  Sums are of whole numbers and decimals, so that their order does not show.
    while True:
        full = F.col("ceiling") <= share * F.col("weight")
        filled, open_weight, open_ = weighed.agg(
            F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight").cast("decimal(28,10)"))), F.count_if(~full)
        ).first()
        if not open_ or open_ == open_before:
            break
        share, open_before = (total - most * (filled or 0)) / float(open_weight), open_
    return weighed.withColumn("target", F.least("ceiling", F.col("weight") * share) if open_ else F.col("ceiling")).drop("ceiling")


def settled(p: np.ndarray) -> np.ndarray:
    return np.where(p < EPSILON, 0.0, np.where(p > 1 - EPSILON, 1.0, p))


def fly_heavy(size: np.ndarray, p: np.ndarray, random: np.random.Generator, left: int) -> np.ndarray:
    """Decides the largest documents while many others can make up for them: steps along the projection
    of one document onto the directions that keep both sums, over all undecided ones."""
    p = p.copy()
    for heavy in np.argsort(-size, kind="stable")[:HEAVY]:
        while 0 < p[heavy] < 1:
            open_ = np.flatnonzero((p > 0) & (p < 1))
            if len(open_) <= max(left, 2):
                return p
            a = np.stack([np.ones(len(open_)), size[open_] / size[heavy]])
            u = (open_ == heavy).astype(float)
            u -= a.T @ (np.linalg.pinv(a @ a.T) @ (a @ u))
            moving = np.abs(u) > 1e-12 * np.abs(u).max()
            if np.abs(u).max() < 1e-9:  # the others can't move without it
                break
            q, x = p[open_][moving], u[moving]
            up, down = (float(np.where(x * way > 0, (1 - q) / np.abs(x), q / np.abs(x)).min()) for way in (1, -1))
            step = up if random.random() * (up + down) < down else -down
            p[open_[moving]] = settled(q + step * x)
    return p


def fly(size: np.ndarray, p: np.ndarray, random: np.random.Generator, left: int) -> np.ndarray:
    """Probabilities after moving them, the largest documents first and then three at a time, so that
    the sums of p and of p * size stay and each p is kept in expectation, until at most ``left`` lie
    between 0 and 1."""
    p = fly_heavy(size, p, random, left)
    waiting = [i for i in range(len(p)) if 0 < p[i] < 1]
    undecided, following = len(waiting), 0
    draws = random.random(undecided).tolist()
    sizes, probabilities = size.tolist(), p.tolist()
    pool: list[int] = []
    while undecided > max(left, 2):
        while len(pool) < 3:
            pool.append(waiting[following])
            following += 1
        a, b, c = pool
        # Steps along u keep u.sum() and (u * size).sum() at 0.
        u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
        if not (u[0] or u[1] or u[2]):
            u = (1, -1, 0)
        up = min([(1 - probabilities[i]) / x if x > 0 else probabilities[i] / -x for i, x in zip(pool, u) if x])
        down = min([probabilities[i] / x if x > 0 else (1 - probabilities[i]) / -x for i, x in zip(pool, u) if x])
        step = up if draws[undecided - 1] * (up + down) < down else -down
        stay = []
        for i, x in zip(pool, u):
            v = probabilities[i] + step * x
            if v < EPSILON or v > 1 - EPSILON:
                v = float(v > 0.5)
                undecided -= 1
            else:
                stay.append(i)
            probabilities[i] = v
        pool = stay
    return np.array(probabilities, np.float64)


def land(size: np.ndarray, p: np.ndarray, scale: float) -> np.ndarray:
    """Decides the last few: the subset whose tokens and number are closest to what is expected."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if not len(open_):
        return p
    subsets = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
    tokens = subsets @ size[open_] - size[open_] @ p[open_]
    documents = subsets.sum(axis=1) - p[open_].sum()
    best = int(np.argmin(np.abs(tokens) / max(scale, 1e-300) + DOCUMENT_WEIGHT * np.abs(documents)))
    p = p.copy()
    p[open_] = subsets[best]
    return p


def _flown(batches, columns: list[str], seed: int):
    """Flies the chunks of batches that are sorted by (place, chunk, h, p); a source's only chunk also lands.
    A chunk that many rows with equal ``h`` make too large flies in parts."""
    held: list[pa.Table] = []
    n, of = 0, None

    def done():
        table = pa.concat_tables(held).combine_chunks()
        size, p = table.column("size").to_numpy().astype(np.float64), table.column("p").to_numpy()
        random = np.random.default_rng([seed & 0xFFFFFFFF, of[0], of[1], int(table.column("h")[0].as_py()) & 0xFFFFFFFFFFFFFFFF])
        p = fly(size, p, random, LEFT)
        if table.column("chunks")[0].as_py() == 1:
            p = land(size, p, float(size.mean()))
        table = table.set_column(table.column_names.index("p"), "p", pa.array(p)).select(columns)
        return table.to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        place, chunk = table.column("place").to_numpy(), table.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]) | (chunk[1:] != chunk[:-1])) + 1), table.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            key = (int(place[s]), int(chunk[s]))
            while s < e:
                if held and (key != of or n == 4 * CHUNK):
                    yield from done()
                    held, n = [], 0
                of, some = key, min(e - s, 4 * CHUNK - n)
                held.append(table.slice(s, some))
                s, n = s + some, n + some
    if held:
        yield from done()


def decided(spark: SparkSession, rows: DataFrame, seed: int = 0) -> DataFrame:
    """``rows`` (place, size, p, h and others) with p moved to 0 or 1.

    Each place's sums of p and of p * size are kept but for its landing.  Rows are told apart by ``h``, a hash
    of what the caller returns of them, so that reruns and other partitions give the same result.
    """
    columns = rows.columns
    fractional = (F.col("p") > 0) & (F.col("p") < 1)
    left, out, depth = rows, None, 0
    while True:
        # A chunk has its share of a source's rows by hash, whatever the source's size.
        sizes = left.where(fractional).groupBy("place").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
        sizes = written(sizes, spark, "chunks")
        if sizes.isEmpty():
            return left if out is None else out.unionByName(left)
        if out is None:
            out = left.where(~fractional)
        dealt = left.where(fractional).join(small(sizes, sizes.count(), 64), "place").withColumn("chunk", F.pmod(F.xxhash64("h", F.lit(depth)), F.col("chunks")))
        dealt = dealt.repartition("place", "chunk").sortWithinPartitions("place", "chunk", "h", "p")
        flown = written(dealt.mapInArrow(lambda batches, d=depth: _flown(batches, columns, seed + d), rows.schema), spark, "flown")
        out, left, depth = out.unionByName(flown.where(~fractional)), flown.where(fractional), depth + 1


def mixed(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = 0) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): doc_id, source, size, source_size, target, copies.

    ``copies`` is how often the mix takes the document.  Documents without words are taken 0 times, also
    all of a source without words; a null source is a source of its own, after all others.  Rows with
    the same doc_id, source and size are alike: the same number of them is taken in every run.  Other
    columns are ignored; an empty table gives no rows.
    """
    rows = written(sized(docs), spark, "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = written(targets(spark, sources, weights, budget, most), spark, "targets")
    named = rows.join(small(aims, aims.count(), 128).withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    times = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole: Column = F.floor(times + EPSILON)
    rest = F.when(times - whole < EPSILON, 0.0).otherwise(times - whole)
    wanted = named.select("doc_id", "source", "size", "source_size", "target", "place", whole.cast("int").alias("whole"), rest.alias("p"), F.xxhash64("doc_id", "size", "source", F.lit(seed)).alias("h"))
    return decided(spark, wanted, seed).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def repeated(docs: DataFrame, mix: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them; ``key`` names a document in both and is unique."""
    times = mix.select(F.col(key).alias("_key"), "copies").where("copies > 0")
    joined = docs.join(times, F.col(key) == F.col("_key"))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_key", "copies", "_copy")


def op11(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mixed(spark, docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
