"""Balanced sampling: targets, totals, expectations, reruns."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import AWKWARD, documents  # noqa: F401

from fleetspark.llm import cube_mix
from fleetspark.llm.tables import table

SMALL = "/root/testdata/sf0.01"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shared(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    """Targets by resharing the excess until none is above: sizes by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, rest = dict.fromkeys(names, 0.0), set(names), budget * sum(sizes.values())
    while open_ and rest > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += rest * weight[s] / total
        rest = sum(max(0.0, target[s] - most * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def totals(rows):
    out = defaultdict(int)
    for r in rows:
        out[r["source"]] += r["size"] * r["copies"]
    return out


def checked(spark, docs, near=0.02):
    rows = cube_mix.mixed(spark, docs).collect()
    texts = docs.select("doc_id", "source", "text").collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter((r["doc_id"], r["source"], words(r["text"])) for r in texts)
    sizes = defaultdict(int)
    for r in texts:
        sizes[r["source"]] += words(r["text"])
    target, taken, largest = shared(sizes), totals(rows), defaultdict(int)
    for r in rows:
        assert 0 <= r["copies"] <= 2 and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["size"] or not r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= near * target[s] + 1
    return rows


def test_given_documents(spark):
    rows = checked(spark, table(spark, SMALL, "documents"))
    # Document totals are balanced too.
    for s in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == s and r["size"]]
        assert abs(sum(r["copies"] for r in mine) - len(mine) * mine[0]["target"] / mine[0]["source_size"]) <= 4


def test_query(spark):
    docs = table(spark, SMALL, "documents")
    full = {tuple(r) for r in cube_mix.mixed(spark, docs).selectExpr("doc_id", "size", "source_size", "target", "size * copies", "copies").collect()}
    again = {tuple(r) for r in cube_mix.op11(spark, docs.repartition(7)).collect()}
    assert full == again and len(full) == docs.count()


def test_many_levels_and_a_hot_source(spark, documents, monkeypatch):
    monkeypatch.setattr(cube_mix, "CHUNK", 64)
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 40)), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(4000)]
    first = checked(spark, documents(rows), near=0.002)
    assert Counter(first) == Counter(cube_mix.mixed(spark, documents(rows, 11)).collect())


def test_many_equal_rows(spark, documents, monkeypatch):
    """Rows that no hash can tell apart still fly in bounded parts, and the same number is taken."""
    monkeypatch.setattr(cube_mix, "CHUNK", 16)
    docs = documents([(1, "a b c", "en", "s")] * 700 + [(i, "a " * (i % 5), "en", "t") for i in range(200)])
    checked(spark, docs)


def test_odd_rows(spark, documents):
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 4}") for i, t in enumerate(AWKWARD)]
    rows += [(None, "no id", "en", "s1"), (3, "twice here", "en", "s1"), (3, "twice here", "en", "s1"), (5, None, "en", "empty"), (6, "", "en", "empty"), (9, "é " * 700_000, "en", "long"), (10, "x" * 3_000_000, "en", "long")]
    docs = documents(rows)
    checked(spark, docs.selectExpr("*", "doc_id AS p", "source AS place", "1 AS size", "'x' AS chunk"), near=1.0)
    assert cube_mix.op11(spark, docs.limit(0)).columns == ["doc_id", "size", "source_size", "target", "taken", "copies"]
    assert cube_mix.op11(spark, docs.limit(0)).count() == 0
    assert [tuple(r)[1:5] for r in cube_mix.op11(spark, documents([(1, None), (2, " ")])).collect()] == [(0, 0, 0.0, 0)] * 2


def test_flight_keeps_sums_and_expectations():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 60, 40).astype(float), rng.random(40) * 0.9 + 0.05
    met = np.zeros(40)
    for k in range(3000):
        out = cube_mix.fly(size, p, np.random.default_rng(k), 2)
        assert out.sum() == pytest.approx(p.sum()) and out @ size == pytest.approx(p @ size)
        assert ((out > 0) & (out < 1)).sum() <= 2 and out.min() >= 0 and out.max() <= 1
        met += out
    assert np.abs(met / 3000 - p).max() < 0.04


def test_heavy_documents_are_made_up_for():
    """One document with a fifth of all tokens: the others balance it, whichever way it goes."""
    size, p = np.append(np.random.default_rng(3).integers(50, 900, 49), 5184).astype(float), np.full(50, 0.597)
    for k in range(40):
        out = cube_mix.land(size, cube_mix.fly(size, p, np.random.default_rng(k), cube_mix.LEFT), size.mean())
        assert abs(out @ size - p @ size) < 0.01 * (p @ size)


def test_landing_takes_the_closest_subset():
    size, p = np.array([5.0, 3.0, 2.0, 100.0]), np.array([0.5, 0.5, 0.5, 0.0])
    out = cube_mix.land(size, p, 1.0)
    assert out[3] == 0 and abs(out @ size - 5) == 0 and set(out) <= {0.0, 1.0}


def test_repeated(spark, documents):
    docs = documents([(i, "a b", "en", f"s{i % 3}") for i in range(30)])
    mix = cube_mix.mixed(spark, docs)
    out = cube_mix.repeated(docs, mix)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({r["doc_id"]: r["copies"] for r in mix.collect() if r["copies"]})
