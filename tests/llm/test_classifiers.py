"""Quality, language and toxicity: held-out accuracy, exact neighbours, awkward rows."""

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import AWKWARD, documents  # noqa: F401

from fleetspark.llm import langid, quality, toxicity
from fleetspark.llm.tables import table

LARGER = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"
WORDS = "stone river light paper garden window silver mountain winter candle harbor meadow".split()


def prose(i, extra=()):
    rng = np.random.default_rng(i)
    return " ".join([*rng.choice(WORDS, 40), *extra])


def area(good, bad):
    """Share of pairs in which the good one scores higher."""
    return np.mean([g > b for g in good for b in bad])


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, LARGER, "documents"), table(spark, LARGER, "labels")


def test_quality_held_out(tables):
    docs, labels = tables
    rows = quality.op1(docs.sparkSession, docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = rows[rows.quality == 1].score, rows[rows.quality == 0].score
    assert area(good, bad) > 0.99 and (good >= 0.3).mean() > 0.99 and (bad < 0.3).mean() > 0.9


def test_quality_never_sees_held_out_labels(tables):
    docs, labels = tables
    from pyspark.sql import functions as F

    from fleetspark.llm.tables import fold_of

    held = fold_of(F.col("doc_id"), 5) == 0
    wrong = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit(docs, labels, 300), quality.fit(docs, wrong, 300))


def test_ftrl_is_the_textbook_update():
    examples = [(np.array([0, 1]), np.array([1.0, 2.0]), 1.0), (np.array([1, 2]), np.array([1.0, 1.0]), 0.0)] * 3
    alpha, beta, l1, l2 = 1.0, 1.0, 0.0005, 0.001
    z, n = np.zeros(3), np.zeros(3)
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
    for index, x, y in examples:
        w = {i: weight(i) for i in index}
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(index, x))))
        for i, v in zip(index, x):
            g = (p - y) * v
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w[i]
            n[i] += g * g
    assert np.allclose(quality.ftrl(examples, 1)[:3], [weight(i) for i in range(3)])


def test_quality_scores_are_sparse_products(documents):
    text = "One two two !! tail"
    weights = np.zeros((1 << quality.BITS) + 1)
    for _, buckets, counts in quality.features(pa.array([text])):
        assert counts.tolist() == [5 + 4]
        weights[buckets] = np.arange(1, len(buckets) + 1) / 10
    weights[-1] = -0.5
    margin = -0.5 + sum(weights[b] for _, bs, _ in quality.features(pa.array([text])) for b in bs) * quality.SCALE / 9
    got = quality.score(documents([(1, text)]), weights).first()
    assert abs(got.quality_score - 1 / (1 + np.exp(-margin))) < 1e-5


def test_awkward_rows_score(spark, documents):
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(None, "no id"), (0, "again"), (0, "again")]
    docs = documents(rows).withColumnRenamed("lang", "label").withColumnRenamed("source", "quality")
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(30)] + [(1, 0, 0), (None, 1, 1), (2, None, None)], LABELS)
    for out in (quality.op1(spark, docs, labels), toxicity.op8(docs, labels)):
        got = out.collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert all(r.held_out is not None for r in got)


def test_without_labels_or_rows(spark, documents):
    docs, none = documents([(1, "some words"), (2, None)]), spark.createDataFrame([], LABELS)
    assert {r.score for r in quality.op1(spark, docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.op8(docs, none).collect()} == {0.0}
    empty = docs.where("doc_id > 5")
    assert quality.op1(spark, empty, none).collect() == toxicity.op8(empty, none).collect() == langid.op6(empty).collect() == []
    assert {r.lang_pred for r in langid.op6(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_language_held_out(tables):
    docs, _ = tables
    rows = langid.op6(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.98
    sure = rows[rows.accepted]
    assert len(sure) > 0.9 * len(rows) and (sure.lang == sure.lang_pred).mean() >= (rows.lang == rows.lang_pred).mean()


def test_language_of_texts_without_letters(documents):
    rows = [(i, "le chat est sur la table" if i % 2 else "the cat is on the table", "fr" if i % 2 else "en") for i in range(60)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "123 !? --", "en"), (103, "日本語", None), (None, "the table", "en")]
    got = {r.doc_id: r for r in langid.op6(documents(rows + odd)).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[103].lang_pred in ("en", "fr") and got[None].lang_pred == "en"
    assert np.mean([got[r[0]].lang_pred == r[2] for r in rows]) == 1


def test_subwords_are_whole_text_grams():
    def plain(text):
        code = [c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode()]
        out = []
        for size in range(1, 5):
            for i in range(len(code) - size + 1):
                g = code[i : i + size]
                if 32 in g[1:-1] or all(c == 32 for c in g):
                    continue
                out.append(tuple(g))
        return len(out)

    texts = ["ab c", "", "The cat, 12 sat", " x ", "aé"]
    for at, text in enumerate(texts):
        got = sum(len(b) for _, b, _, _ in langid.subwords(pa.array([text])))
        assert got == plain(text), text


@pytest.mark.parametrize("frequent", [0, 5, 256])
def test_neighbours_are_exact(monkeypatch, frequent):
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(500):
        t = np.unique(rng.zipf(1.6, rng.integers(0, 6)) % 40)
        vectors.append((t, rng.integers(1, 5, len(t)).astype(float)))
    idf, tells, labels = rng.uniform(1, 6, 40), rng.uniform(0.05, 1, 40), rng.integers(0, 2, 500)
    sizes = np.array([len(t) for t, _ in vectors])
    index = toxicity.Index(np.arange(500), labels, np.concatenate([t for t, _ in vectors]), np.concatenate([f for _, f in vectors]), sizes, np.arange(40).astype(np.uint64), idf, tells)
    unit = np.zeros((500, 40))
    for i, (t, f) in enumerate(vectors):
        unit[i, t] = (1 + np.log(f)) * idf[t] * tells[t]
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    got = index.nearest(vectors, list(range(500)), 16)
    for j in range(500):
        scores = sorted(((round(float(unit[p] @ unit[j]), 9), p) for p in range(500) if p != j and unit[p] @ unit[j] > 1e-12), key=lambda x: (-x[0], x[1]))[:16]
        assert [s for s, _ in got[j]] == pytest.approx([s for s, _ in scores], abs=2e-9)
        assert [p for _, p in got[j]] == [p for _, p in scores] or len({s for s, _ in scores}) < len(scores)


def brute_toxicity(docs, labels, k=16):
    """Neighbours of every text from the raw texts: doc_id -> (ids, cosines)."""
    import re
    import zlib
    from collections import Counter
    from math import log, sqrt

    def bag(text):
        words = re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())
        return Counter([w for w in words] + [(w[:5],) for w in words if len(w) > 5])

    bags = [(i, bag(t)) for i, t in docs]
    known = {i: toxic for i, toxic in labels if zlib.crc32(str(i).encode()) % 5}
    examples = [(i, b) for i, b in bags if i in known]
    n, toxic, has, has_toxic, anywhere = len(examples), sum(known[i] for i, _ in examples), Counter(), Counter(), Counter()
    for i, b in examples:
        has.update(b.keys())
        has_toxic.update(b.keys() if known[i] else ())
    for _, b in bags:
        anywhere.update(b.keys() & has.keys())
    weight = {}
    for t, m in has.items():
        expected = m * toxic / n
        variance = expected * (1 - toxic / n) * (1 - m / n) * n / (n - 1)
        chi = (has_toxic[t] - expected) ** 2 / variance if variance > 1e-12 else 0
        tells = min(1, max(0.05, (chi / (2 * log(len(has) / 0.05))) ** 2))
        weight[t] = (log((1 + len(bags)) / (1 + anywhere[t])) + 1) * tells

    def unit(b):
        v = {t: (1 + log(m)) * weight[t] for t, m in b.items() if t in weight}
        length = sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / length for t, x in v.items()}

    vectors = [(i, unit(b)) for i, b in examples]
    out = {}
    for i, b in bags:
        q = unit(b)
        out[i] = sorted(((-sum(x * v.get(t, 0) for t, x in q.items()), j) for j, v in vectors if j != i))[:k]
    return out


def test_neighbours_from_raw_texts(spark, documents):
    rng = np.random.default_rng(8)
    rows = [(i, prose(i, rng.choice(["zorkish", "Zorkishly", "grumbling", "é-tude", "x1"], 3))) for i in range(250)]
    rows += [(300, None), (301, ""), (302, "unknown words only"), (303, "ZORKISH " * 9), (304, "a" * 2_000_000 + " zorkish"), (305, "stone river " * 100_000)]
    known = [(i, int("zorkish" in t.lower())) for i, t in rows[:200]] + [(304, 1), (305, 0)]
    labels = spark.createDataFrame([(i, 1, toxic) for i, toxic in known], LABELS)
    docs = documents(rows)
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    for i, expected in brute_toxicity(rows, known).items():
        expected = [x for x in expected if x[0] < -1e-12]
        assert got[i].cosines == pytest.approx([-s for s, _ in expected], abs=1e-8)
        steps = [b - a for (a, _), (b, _) in zip(expected, expected[1:])]
        assert got[i].neighbours == [j for _, j in expected] or min(steps, default=1) < 1e-8
    assert got[300].neighbours == got[302].neighbours == [] and got[303].score > 0.5 and 0 <= got[300].score <= 1


def test_example_bounds(documents, spark):
    rows = [(i, prose(i)) for i in range(100)]
    docs, labels = documents(rows), spark.createDataFrame([(i, 1, i % 2) for i in range(100)], LABELS)
    assert len(toxicity.fit(docs, labels, example_rows=30).ids) == 30
    few = toxicity.fit(docs, labels, example_terms=200).ids
    assert 1 <= len(few) < 30


def test_toxicity_held_out(tables):
    docs, labels = tables
    rows = toxicity.op8(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    # Some 350 toxic examples do not show every form of each toxic word.
    assert (rows[rows.toxic == 1].predicted == 1).mean() > 0.85
    assert (rows[rows.toxic == 0].predicted == 0).mean() > 0.99


def test_toxicity_evidence(spark, documents):
    rows = [(i, prose(i, ["zorkish"] if i % 4 == 0 else [])) for i in range(300)] + [(1000, prose(1000, ["zorkish", "zorkish"])), (1001, prose(1001))]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], LABELS)
    got = {r.doc_id: r for r in toxicity.op8(documents(rows), labels).collect()}
    assert got[1000].predicted == 1 and got[1001].predicted == 0
    assert all(int(i) % 4 == 0 for i in got[1000].neighbours.split(",")) and got[1001].neighbours
    assert "4" not in got[4].neighbours.split(",")


def test_runs_and_ranges():
    plain = lambda x: [(int(p[0]), int(p[-1]) + 1) for p in np.split(x, np.flatnonzero(np.diff(x) != 1) + 1) if len(p)]
    for numbers in ([], [3], [0, 1, 2, 3], [0, 2, 3, 7], [5, 6, 8]):
        x = np.array(numbers, np.int64)
        assert toxicity._runs(x) == plain(x)
    starts, sizes = np.array([4, 9, 0, 7]), np.array([2, 0, 3, 1])
    assert toxicity._ranges(starts, sizes).tolist() == [4, 5, 0, 1, 2, 7]
