"""Language identification: averaged hashed subword embeddings, linear softmax, calibrated rejection."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm import textops
from fleetspark.llm.tables import fold_of

BITS = 15
DIMENSIONS = 16
#: Bound of the training sample (documents).
SAMPLE_ROWS = 4096
EPOCHS = 6
BATCH = 32
SEED = 7
FOLDS, HELD_OUT = 4, 2
#: Share of right training answers that rejection may cost.
MAX_LOSS = 0.01
UNKNOWN = "und"
HAS_LETTER = r"\p{L}"


def subwords(column: pa.Array):
    """Yields (first row, bucket of every subword, subwords per row): the 1- to 4-byte grams of each
    lower-cased word with its two ends, over whole texts."""
    kind, folded = textops.byte_classes(lower=True, punctuation=False)
    for digit in b"0123456789":
        kind[digit] = 0
    code = np.where(kind > 0, folded, 32).astype(np.uint64)
    for first, data, offsets in textops.utf8_slices(column):
        n = len(data)
        c = code[data]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        out, rows = [], []
        h = np.zeros(n, np.uint64)
        letter = c != 32
        for size in range(1, 5):
            if n < size:
                break
            h = h[: n - size + 1] * np.uint64(257) + c[size - 1 :]
            ok = row[: n - size + 1] == row[size - 1 :]
            # Blanks may stand at the ends only, and not alone.
            inner = np.ones(n - size + 1, bool)
            for i in range(1, size - 1):
                inner &= letter[i : n - size + 1 + i]
            ok &= inner & (letter[: n - size + 1] if size == 1 else letter[: n - size + 1] | letter[size - 1 :] if size == 2 else True)
            out.append(textops.mix(h[ok] * np.uint64(8) + np.uint64(size)) >> np.uint64(64 - BITS))
            rows.append(row[: n - size + 1][ok])
        buckets = np.concatenate(out) if out else np.zeros(0, np.uint64)
        rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        yield first, buckets.astype(np.int32), rows, len(offsets) - 1


def train(rows: pa.Table) -> pa.Table:
    """One row: the names, the product of embeddings and softmax weights, bias, temperature and
    rejection limit.  A tenth of the rows is kept out of the descent and sets the last two."""
    rows = rows.combine_chunks().sort_by([("place", "ascending"), ("doc_id", "ascending")])
    names, target = np.unique(rows["lang"].to_pylist(), return_inverse=True)
    texts = rows["text"].combine_chunks()
    sparse = []
    for at in range(len(texts)):
        found = [b for _, b, _, _ in subwords(texts.slice(at, 1))]
        i, c = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0))
        sparse.append((i, (c / max(1, c.sum())).astype(np.float32)))
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(sparse))
    tuning, learning = order[: max(1, len(order) // 10)], order[len(order) // 10 :]
    embed = rng.normal(0, 0.3, (1 << BITS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((DIMENSIONS, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps = 0
    total = max(1, EPOCHS * -(-len(learning) // BATCH))
    for _ in range(EPOCHS):
        rng.shuffle(learning)
        for s in range(0, len(learning), BATCH):
            rate = 2.0 * (1 - steps / total) + 0.02
            steps += 1
            part = learning[s : s + BATCH]
            hidden = np.stack([sparse[j][1] @ embed[sparse[j][0]] for j in part])
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), target[part]] -= 1
            back = p @ out.T
            out -= rate * hidden.T @ p / len(part)
            bias -= rate * p.mean(axis=0) * 0.1
            for j, g in zip(part, back):
                embed[sparse[j][0]] -= (rate * 20 / len(part)) * sparse[j][1][:, None] * g
    table = embed @ out
    z = np.stack([sparse[j][1] @ table[sparse[j][0]] for j in tuning]) + bias
    # The temperature with the least log loss on the kept-out rows.
    scales = np.geomspace(0.2, 5, 25)
    p = [softmax(z * t) for t in scales]
    loss = [-np.log(q[np.arange(len(tuning)), target[tuning]] + 1e-12).mean() for q in p]
    best = int(np.argmin(loss))
    right = p[best].argmax(axis=1) == target[tuning]
    sure = np.sort(p[best].max(axis=1)[right])
    limit = float(sure[int(len(sure) * MAX_LOSS)]) if len(sure) else 0.0
    file = io.BytesIO()
    np.savez(file, names=names, table=(table * scales[best]).astype(np.float32), bias=bias * scales[best], limit=limit)
    return pa.table({"model": pa.array([file.getvalue()], pa.binary())})


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> bytes | None:
    """A model from at most ``sample_rows`` documents with a language, outside the held-out fold; None without any."""
    ids = (
        docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
        .where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT).select("doc_id").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    # ``ids`` has at most ``sample_rows`` numbers, so it may be broadcast.
    sample = (
        docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
        .join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("d"))
        .select("doc_id", "d.text", "d.lang", F.xxhash64("doc_id").alias("place"), F.lit(0).alias("one"))
    )
    found = sample.groupBy("one").applyInArrow(train, "model binary").collect()
    return bytes(found[0]["model"]) if found else None


def predict(docs: DataFrame, model: bytes | None) -> DataFrame:
    """``docs`` (doc_id, text) with lang_pred, score and accepted (false: below the calibrated limit)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches):
        m = np.load(io.BytesIO(held.value)) if held.value else None
        names, table, bias, limit = (m["names"], m["table"], m["bias"], float(m["limit"])) if m else (None,) * 4
        for batch in batches:
            n = batch.num_rows
            lang, p = np.full(n, UNKNOWN, object), np.zeros(n)
            if m:
                z = np.zeros((n, len(names)))
                for first, buckets, rows, count in subwords(batch.column("text")):
                    size = np.maximum(np.bincount(rows, minlength=count), 1)
                    for k in range(len(names)):
                        z[first : first + count, k] = np.bincount(rows, table[buckets, k], count) / size
                q = softmax(z + bias)
                lang, p = names[q.argmax(axis=1)].astype(object), q.max(axis=1)
            accepted = p >= (limit or 0.0) if m else np.zeros(n, bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lettered"), pa.array(lang, pa.string()), pa.array(p), pa.array(accepted)],
                ["doc_id", "lettered", "lang_pred", "score", "accepted"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(HAS_LETTER), F.lit(False)).alias("lettered"))
    out = rows.mapInArrow(predicted, f"doc_id {id_type}, lettered boolean, lang_pred string, score double, accepted boolean")
    return out.select(
        "doc_id", F.when(F.col("lettered"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("score")).otherwise(0.0).alias("score"), (F.col("lettered") & F.col("accepted")).alias("accepted"),
    )


def op6(docs: DataFrame) -> DataFrame:
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted",
    )
