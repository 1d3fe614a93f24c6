"""Hard negatives against comparing all rows with all."""

import math

import numpy as np
import pytest

from fleetspark.llm import vertical_scan
from fleetspark.llm.tables import table

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """Rows (vec_id, embedding, label) -> the contract's rows, number by number."""
    taken = set()
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        taken.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in vector)))
    out = []
    for anchor, label, q in taken:
        if anchor % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i, other) for i, other, v in taken if i != anchor)
        for s, i, _ in [x for x in scored if x[2] == label][:5]:
            window = [(t, j) for t, j, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(anchor, i, rank, j, -s, -t) for rank, (t, j) in enumerate(window[:5], 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def made(n, dims, seed, grid=False):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (n, dims)) / 256 if grid else rng.normal(size=(n, dims))
    return [(i, x[i].tolist(), int(rng.integers(0, 3))) for i in range(n)]


def test_given_vectors(spark):
    df = table(spark, SMALL, "embeddings")
    assert found(vertical_scan.op12(df)) == brute([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])


@pytest.mark.parametrize("grid", [False, True])
def test_blocks_and_ties(spark, monkeypatch, grid):
    """Small blocks, one hot label; on the grid most scores tie."""
    monkeypatch.setattr(vertical_scan, "LEAST_ROWS", 16)
    monkeypatch.setattr(vertical_scan, "STEP", 2)
    rows = made(900, 7, 3, grid)
    out = vertical_scan.op12(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert found(out) == brute(rows)


def test_odd_rows(spark):
    rows = made(60, 3, 5)
    rows = [(i * 50, v, label) for i, v, label in rows]
    rows += [(7, None, 1), (None, [1.0, 2.0, 3.0], 1), (100 * 7, [0.0, 0.0, 0.0], 2), (8, [1.0, None, 2.0], 1), (9, [1.0, float("nan"), 2.0], 1), (12, [1.0, float("inf"), 0.0], 1), (13, [0.1, 0.2, 0.3], None)]
    rows += [rows[0], rows[1], (300, [0.5, 0.5, 0.5], 1), (15, [], 0), (100000, [], 0), (-700, [0.3, 0.3, 0.1], 9), (21, [1.0], 2147483647)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", score string, rank int")
    assert found(vertical_scan.op12(df)) == brute(rows)


def test_empty_and_lonely(spark):
    assert found(vertical_scan.op12(spark.createDataFrame([], SCHEMA))) == []
    assert found(vertical_scan.op12(spark.createDataFrame([(100, [1.0], 1)], SCHEMA))) == []
    assert found(vertical_scan.op12(spark.createDataFrame([(100, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)], SCHEMA))) == [(100, 1, 1, 2, 256 * 256, 256 * 230)]


def test_scores_past_doubles(spark):
    """Sums beyond 2^53 are taken in whole numbers; beyond 64 bits they stop at the ends."""
    big = [3e9, 1.0]
    rows = [(100, [1e2, 1.0], 1), (1, big, 1), (2, [2.9e9, 0.5], 2), (3, [2.9e9, 0.25], 2), (4, [-1e30, 0.0], 2)]
    assert found(vertical_scan.op12(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    out = found(vertical_scan.op12(spark.createDataFrame([(100, [1e30], 1), (1, [1e30], 1), (2, [1e30], 2)], SCHEMA)))
    assert out == [(100, 1, 1, 2, 2**63 - 1, 2**63 - 1)]


def test_scan_leaves_what_counts():
    """Candidates fall off before all columns are read, and none that counts."""
    rng = np.random.default_rng(1)
    x = rng.integers(-200, 200, (4000, 32)) * np.array([20] + [1] * 31)
    block = vertical_scan.Block(np.arange(4000), np.zeros(4000, int), x.ravel(), np.full(4000, 32))
    q, seen = x[17], []
    keep = lambda rows, low, high: (seen.append(len(rows)), high >= vertical_scan.nth_highest(low, 5))[1]
    rows, scores = block.scan(q, np.arange(4000), keep)
    full = x @ q
    assert set(np.argsort(-full)[:5]) <= set(rows) and (scores == full[rows]).all()
    assert seen[-1] <= 10 and sum(seen) < 0.7 * 4000 * len(seen)
