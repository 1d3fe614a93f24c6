"""Hard negatives by vertical scans: one dimension after another, the anchor's largest first.

A block of rows lies column by column in its task.  For an anchor the columns are read in the order
of its components' magnitudes.  What the unread columns can still add to a row's score lies between
sums of each column's smallest and largest contribution, so rows that can no longer be among the
best, or in a window of scores, leave the candidates long before all columns are read.  The few
rows that stay have exact scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm.tables import written

POSITIVES = 5
NEGATIVES = 5
#: A negative's score lies between this many hundredths of its positive's score and all of it.
LOWEST_SHARE = 80
#: Rows in a block: at most so many, fewer where the rows would not make ``LEAST_BLOCKS`` blocks.
BLOCK_ROWS = 32768
LEAST_BLOCKS = 12
LEAST_ROWS = 1024
#: Columns read between two looks at the bounds.
STEP = 4
LONG = 1 << 63


def vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(id, label, v): whole-number vectors of the rows that take part.

    A row takes part if id and label are not null and the vector has no null or non-finite
    component.  Components become floor(scale * x); they stop at the ends of a 64-bit number.
    Rows equal in all three count once.  Short vectors are as if filled up with zeros.
    """
    x = F.col("embedding")
    whole = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).where(F.coalesce(whole, F.lit(False)))
        .select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))
        .distinct()
    )


class Block:
    """Rows of one block, column by column."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, lengths: np.ndarray):
        self.ids, self.labels = ids, labels
        n, dims = len(ids), int(lengths.max()) if len(lengths) else 0
        columns = np.zeros((dims, n), np.int64)
        row = np.repeat(np.arange(n), lengths)
        columns[np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = values
        self.low, self.high = (f(axis=1) if n and dims else np.zeros(dims, np.int64) for f in (columns.min, columns.max))
        self.largest = int(max(abs(int(self.low.min())), abs(int(self.high.max())))) if n and dims else 0
        # Sums of doubles are exact as far as they are whole numbers below 2^53; beyond, Python's numbers are.
        self.exact, self.columns = columns, columns.astype(np.float64)

    def scan(self, q: np.ndarray, rows: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) that ``keep(rows, lowest, highest)`` leaves once all columns are read."""
        q = q[: len(self.columns)]
        doubles = sum(abs(int(x)) for x in q) * self.largest < 1 << 53
        kind = np.float64 if doubles else object
        columns = self.columns if doubles else self.exact.astype(object)
        order = np.argsort(-np.abs(q.astype(np.float64)), kind="stable")
        order = order[q[order] != 0]
        ends = np.stack([q.astype(kind) * x[: len(q)].astype(kind) for x in (self.low, self.high)])
        # What all columns from place k of the order on can still add, at least and at most.
        left = np.zeros((2, len(order) + 1), kind)
        left[0, :-1], left[1, :-1] = (np.cumsum(f(ends, axis=0)[order][::-1])[::-1] for f in (np.min, np.max))
        sums = np.zeros(len(rows), kind)
        bounded = (lambda x: x) if doubles else lambda x: np.clip(x, -LONG, LONG - 1)
        k = 0
        while len(rows):
            stay = keep(rows, bounded(sums + left[0, k]), bounded(sums + left[1, k]))
            rows, sums = rows[stay], sums[stay]
            if k == len(order):
                break
            some = order[k : k + STEP]
            part = columns[some] if len(rows) == len(self.ids) else columns[np.ix_(some, rows)]
            sums = sums + q[some].astype(kind) @ part
            k += len(some)
        return rows, bounded(sums).astype(np.int64)


def nth_highest(x: np.ndarray, n: int):
    """The n-th highest value, None if there are fewer."""
    if len(x) < n:
        return None
    return np.sort(x)[-n] if x.dtype == object else np.partition(x, len(x) - n)[len(x) - n]


def first_by_score(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    return np.lexsort((ids, ~scores))[:n]


def best(block: Block, q: np.ndarray, rows: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(id, score) of the n best rows; ties go to smaller ids."""

    def keep(rows, low, high):
        at_least = nth_highest(low, n)
        return np.ones(len(rows), bool) if at_least is None else high >= at_least

    rows, scores = block.scan(q, rows, keep)
    return [(int(block.ids[rows[i]]), int(scores[i])) for i in first_by_score(block.ids[rows], scores, n)]


def in_windows(block: Block, q: np.ndarray, rows: np.ndarray, windows: list[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
    """Per window of scores (lowest, highest) the (id, score) of its n best rows; ties go to smaller ids."""
    bounds = sorted(set(windows))

    def keep(rows, low, high):
        stay = np.zeros(len(rows), bool)
        for least, most in bounds:
            may = (high >= least) & (low <= most)
            sure = nth_highest(low[(low >= least) & (high <= most)], n)
            stay |= may if sure is None else may & (high >= sure)
        return stay

    rows, scores = block.scan(q, rows, keep)
    out = []
    for least, most in windows:
        at = np.flatnonzero((scores >= least) & (scores <= most))
        out.append([(int(block.ids[rows[at[i]]]), int(scores[at[i]])) for i in first_by_score(block.ids[rows[at]], scores[at], n)])
    return out


def window_of(positive_score: int) -> tuple[int, int]:
    """Whole scores s with LOWEST_SHARE * p <= 100 * s <= 100 * p."""
    return -(-LOWEST_SHARE * positive_score // 100), positive_score


def _scanned(batches, keys: list[str], answer):
    """``answer(block, anchor row)`` gives tuples for each anchor that follows a block's rows; batches are
    sorted by the keys and kind: 0 row, 1 anchor.  One block is held at a time, anchors pass by."""
    held, block, of = [], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        ids = [table.column(k).to_numpy() for k in [*keys, "kind"]]
        cuts = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1), table.num_rows]
        found = []
        for s, e in zip(cuts, cuts[1:]):
            here, kind, part = tuple(int(x[s]) for x in ids[:-1]), ids[-1][s], table.slice(s, e - s)
            if here != of:
                held, block, of = [], None, here
            if kind == 0:
                held.append(part)
                continue
            if block is None and held:
                rows = pa.concat_tables(held).combine_chunks()
                lists = rows.column("v").combine_chunks()
                block = Block(rows.column("id").to_numpy(), rows.column("label").to_numpy(), lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.value_lengths()))
                held = []
            if block is not None:
                for anchor in part.drop_columns([*keys, "kind"]).to_pylist():
                    found.extend(answer(block, anchor))
        if found:
            yield found


def _blocks(n, rows: int, least_blocks: int):
    """Number of blocks for ``n`` rows."""
    return F.ceil(n / F.least(F.lit(rows), F.greatest(F.lit(LEAST_ROWS), F.ceil(n / least_blocks)))).cast("int")


def positives(rows: DataFrame, anchors: DataFrame, n: int = POSITIVES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor, label, v, positives): per anchor row its best n other rows of the same label, as an
    array of (score, id), best first; anchors without any are left out.  Rows with the anchor's id are
    not other rows.  Anchors meet the blocks of their own label only; a hot label has many blocks."""
    spark = rows.sparkSession
    sizes = rows.groupBy("label").agg(_blocks(F.count("*"), block_rows, 4).alias("blocks"))
    dealt = rows.join(sizes, "label").select("label", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).alias("block"), F.lit(0).alias("kind"), "id", "v")
    asked = anchors.join(sizes, "label").select("label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), F.lit(1).alias("kind"), "id", "v")

    def answer(block, r):
        q = np.array(r["v"], np.int64)
        return [(r["id"], r["label"], r["v"], i, s) for i, s in best(block, q, np.flatnonzero(block.ids != r["id"]), n)]

    def found(batches):
        for some in _scanned(_with_label(batches), ["label_key", "block"], answer):
            yield _columns(some, ["anchor", "label", "v", "id", "score"])

    both = dealt.unionByName(asked.select("label", "block", "kind", "id", "v")).repartition("label", "block").sortWithinPartitions("label", "block", "kind")
    partial = written(both.mapInArrow(found, "anchor long, label long, v array<long>, id long, score long"), spark, "same-label")
    order = Window.partitionBy("anchor", "label", "v").orderBy(F.desc("score"), "id")
    ranked = partial.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
    return ranked.groupBy("anchor", "label", "v").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "score", "id"))), lambda x: F.struct(x["score"], x["id"])).alias("positives"))


def _with_label(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, batch.column("label")], [*batch.schema.names, "label_key"])


def hard_negatives(rows: DataFrame, anchors: DataFrame, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per anchor and positive the best rows of another label in the window below the positive's score.

    ``rows`` and ``anchors`` (id, label, v) are as ``vectors`` gives them.  Columns: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score.  Higher scores come first, ties go
    to smaller ids.  A negative positive score leaves no window.  Every anchor is compared with every
    block; empty tables give no rows.  Scores beyond 64 bits stop at their ends.
    """
    spark = rows.sparkSession
    found = written(positives(rows, anchors, n_positives, block_rows), spark, "positives")
    count = rows.agg(F.count("*").alias("n")).select(F.greatest(F.lit(1), _blocks(F.col("n"), block_rows, LEAST_BLOCKS)).alias("blocks")).first()["blocks"]
    dealt = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(count)).alias("block"), F.lit(0).alias("kind"), "id", "label", "v", F.lit(None).cast("array<struct<score:bigint,id:bigint>>").alias("positives"))
    asked = found.where(F.exists("positives", lambda p: p["score"] >= 0)).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("block"), F.lit(1).alias("kind"), F.col("anchor").alias("id"), "label", "v", "positives"
    )

    def answer(block, r):
        wanted = [(k, p) for k, p in enumerate(r["positives"]) if p["score"] >= 0]
        others = np.flatnonzero(block.labels != r["label"])
        lists = in_windows(block, np.array(r["v"], np.int64), others, [window_of(p["score"]) for _, p in wanted], n_negatives)
        return [(r["id"], r["label"], r["v"], k, p["id"], p["score"], i, s) for (k, p), some in zip(wanted, lists) for i, s in some]

    def found_in(batches):
        for some in _scanned(batches, ["block"], answer):
            yield _columns(some, ["anchor_id", "label", "v", "place", "positive_id", "positive_score", "negative_id", "negative_score"])

    both = dealt.unionByName(asked).repartition("block").sortWithinPartitions("block", "kind")
    partial = both.mapInArrow(found_in, "anchor_id long, label long, v array<long>, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "label", "v", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.list_(pa.int64()) if name == "v" else pa.int64()) for k, name in enumerate(names)], names)


def op12(embeddings: DataFrame) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; where it is divisible by 7 the label first
    becomes (label + 1) % 10.  Rows that take no part, repeated rows and ties: see ``vectors``."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = written(vectors(embeddings.select("vec_id", moved.alias("label"), "embedding")), embeddings.sparkSession, "vectors")
    return hard_negatives(rows, rows.where(F.col("id") % 100 == 0))


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS anchor_id, a.label AS anchor_label, o.id, o.label, CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
  FROM v a JOIN v o ON a.id <> o.id WHERE a.id % 100 = 0
), positives AS (
  SELECT anchor_id, anchor_label, id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""
