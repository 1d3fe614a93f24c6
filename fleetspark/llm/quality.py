"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspark.llm import textops
from fleetspark.llm.tables import fold_of, labelled_sample

BITS = 18
#: Bound of the training sample, and the shards that learn from it on their own.
SAMPLE_ROWS = 8192
SHARDS = 4
#: Passes over a shard: enough for about STEPS examples, within these bounds.
EPOCHS = (3, 40)
STEPS = 12_000
FOLDS = 5
# Feature values are shares of a document's n-grams times this scale.
SCALE = 10.0
THRESHOLD = 0.3
#: Rows handed back at once.
ROWS_OUT = 512


def features(column: pa.Array):
    """Yields (first row, bucket of every n-gram, n-grams per row) for word uni- and bigrams.
    A mark repeated is one word; all bigrams of a word with itself share one bucket."""
    classes = textops.byte_classes(lower=False, punctuation=True)
    for first, data, offsets in textops.utf8_slices(column):
        words = textops.Words(data, offsets, classes)
        h, row = words.hashes(), words.row
        pairs = h[:-1] * np.uint64(3) + h[1:]
        pairs[h[:-1] == h[1:]] = 1
        inside = row[:-1] == row[1:] if len(row) else np.zeros(0, bool)
        buckets = np.concatenate([h, textops.mix(pairs[inside])]) >> np.uint64(64 - BITS)
        rows = np.concatenate([row, row[:-1][inside]])
        order = np.argsort(rows, kind="stable")
        yield first, buckets[order].astype(np.int64), np.bincount(rows, minlength=words.rows)


def ftrl(examples, epochs: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.001) -> np.ndarray:
    """Weights by FTRL-proximal over (buckets, values, label) examples; the last weight is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def solved(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0.0
        return w

    for _ in range(epochs):
        for i, x, y in examples:
            w = solved(i)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            squares = g * g
            z[i] += g - (np.sqrt(n[i] + squares) - np.sqrt(n[i])) / alpha * w
            n[i] += squares
    return solved(np.arange(len(z)))


def _train(rows: pa.Table) -> pa.Table:
    rows = rows.combine_chunks().sort_by([("place", "ascending"), ("doc_id", "ascending")])
    labels = rows["label"].to_numpy()
    examples = []
    for first, buckets, counts in features(rows["text"].combine_chunks()):
        ends = np.cumsum(counts)
        for r, (s, e) in enumerate(zip(ends - counts, ends)):
            i, c = np.unique(buckets[s:e], return_counts=True)
            x = np.append(c * (SCALE / max(1, e - s)), 1.0)
            examples.append((np.append(i, 1 << BITS), x, float(labels[first + r])))
    weights = ftrl(examples, min(EPOCHS[1], max(EPOCHS[0], STEPS // max(1, len(examples)))))
    used = np.flatnonzero(weights)
    return pa.table({"bucket": used, "weight": weights[used]})


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights from the labelled rows outside fold 0, at most ``sample_rows`` of them.
    Shards learn apart and their weights are averaged; without labels all weights are 0."""
    sample = labelled_sample(docs, labels, "quality", FOLDS, 0, sample_rows)
    parts = (
        sample.withColumn("place", F.xxhash64("doc_id")).withColumn("shard", F.pmod("place", F.lit(SHARDS)))
        .groupBy("shard").applyInArrow(_train, "bucket long, weight double")
        .groupBy("bucket").agg((F.sum("weight") / SHARDS).alias("weight")).toArrow()
    )
    weights = np.zeros((1 << BITS) + 1)
    weights[parts["bucket"].to_numpy()] = parts["weight"].to_numpy()
    return weights


def _scores(column: pa.Array, w: np.ndarray) -> np.ndarray:
    margin = np.full(len(column), float(w[-1]))
    for first, buckets, counts in features(column):
        total = textops.sums_by_row(w[buckets].astype(np.float64), counts)
        margin[first : first + len(counts)] += total * SCALE / np.maximum(counts, 1)
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with quality_score (0 to 1) and quality_ok; a null or empty text gets the bias alone.
    Columns of these names give way to the new ones."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("quality_score", "quality_ok")])
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    schema = T.StructType([*docs.schema.fields]).add("quality_score", T.DoubleType()).add("quality_ok", T.BooleanType())
    at = docs.columns.index("text")

    def scored(batches):
        for batch in batches:
            p = _scores(batch.column(at), held.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(p >= threshold)], [*batch.schema.names, "quality_score", "quality_ok"])

    return docs.mapInArrow(scored, schema)


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, as they are."""
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    at = docs.columns.index("text")

    def kept(batches):
        for batch in batches:
            ok = pa.array(_scores(batch.column(at), held.value) >= threshold)
            for s in range(0, batch.num_rows, ROWS_OUT):  # whole texts go back: no second copy of the batch
                yield batch.slice(s, ROWS_OUT).filter(ok.slice(s, ROWS_OUT))

    return docs.mapInArrow(kept, T.StructType([*docs.schema.fields]))


def op1(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"), F.col("quality_ok").cast("int").alias("predicted"),
    )
