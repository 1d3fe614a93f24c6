"""Near-duplicate documents and lines, benchmark leaks and the pipeline against brute force."""

import itertools
import random
import re
import time
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import AWKWARD, SMALL, documents  # noqa: F401

from fleetspark.llm import components, line_dedup, set_join, tiling
from fleetspark.llm.tables import SHUFFLE_CLEANUP, discard, table, written

WORD = [f"w{i}" for i in range(400)]


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def gram_set(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_classes(rows):
    """doc_id -> (class, links to other sets, rows with the set)."""
    sets = {i: gram_set(t) for i, t in rows}
    different = {}
    for i in sorted(sets):
        different.setdefault(sets[i], i)
    reps = [s for s in different if s]
    near = [(a, b) for a, b in itertools.combinations(reps, 2) if 9 * len(a & b) >= 4 * (len(a) + len(b))]
    links = {s: sum(s in p for p in near) for s in reps}
    edges = [(different[a], different[b]) for a, b in near] + [(i, different[s]) for i, s in sets.items() if s]
    root = roots(list(sets), edges)
    return {i: (root[i], links.get(s, 0), sum(x == s for x in sets.values()) if s else 1) for i, s in sets.items()}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def near_corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    for group in range(12):
        base = [rng.choice(WORD) for _ in range(rng.randrange(30, 300))]
        rows += [" ".join(base)] * rng.randrange(1, 4) + [edited(rng, base, rng.randrange(0, 6)) for _ in range(rng.randrange(0, 12))]
    base = [rng.choice(WORD) for _ in range(120)]
    rows += [edited(rng, base, rng.randrange(1, 4)) for _ in range(150)]  # one large group
    common = " ".join(rng.choice(WORD) for _ in range(15))
    rows += [common + " " + " ".join(rng.choice(WORD) for _ in range(40)) for _ in range(120)]  # a shared passage
    rows += ["", " ", "one", "one two", "One, two!", "a b c d", "a b c d e"]
    return list(enumerate(rows))


def test_classes_as_brute_force(spark, documents):
    rows = near_corpus()
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in set_join.op4(spark, documents(rows, 7)).collect()}
    assert got == brute_classes(rows)


def test_large_components_are_dealt_to_chunks(spark, documents, monkeypatch):
    monkeypatch.setattr(set_join, "GROUP_SHINGLES", 2000)
    rows = near_corpus(2)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in set_join.op4(spark, documents(rows, 7)).collect()}
    assert got == brute_classes(rows)


def test_groups_are_bounded_by_sets(spark, documents, monkeypatch):
    monkeypatch.setattr(set_join, "CHUNK", 16)
    largest, dealt = [], set_join._dealt

    def seen(rows, key, *rest):
        out = dealt(rows, key, *rest)
        if key == "root":
            largest.append(out.groupBy("root", "c1", "c2").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(set_join, "_dealt", seen)
    rows = [(i, f"the usual short text of every page with its own number at the end {i}") for i in range(160)]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in set_join.op4(spark, documents(rows)).collect()}
    assert got == brute_classes(rows) and largest[0] < 80


def test_deep_recursion_keeps_the_recall(spark, documents, monkeypatch):
    monkeypatch.setattr(set_join, "LIMIT", 2)  # nearly all buckets recurse to the last level
    rows = near_corpus(3)
    want = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in set_join.op4(spark, documents(rows, 7)).collect()}
    assert np.mean([got[i] == want[i][0] for i in got]) > 0.98


def test_keep_first(spark, documents):
    rows = near_corpus(4)
    want = {c for c, _, _ in brute_classes(rows).values()}
    docs = documents(rows).withColumnRenamed("lang", "__KEEPER2").withColumnRenamed("source", "row_key")
    out = set_join.keep_first(spark, docs)
    assert {r.doc_id for r in out.collect()} == want and out.columns == docs.columns


def test_classes_of_awkward_rows(spark, documents):
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(None, "five words are in here"), (None, "five words are in here"), (7, "five words are in here"), (7, "five words are in here")]
    got = set_join.op4(spark, documents(rows)).collect()
    assert len(got) == len(rows)
    same = [r for r in got if r.n_copies == 4]
    assert len(same) == 4 and {r.class_id for r in same} == {7}
    kept = set_join.keep_first(spark, documents(rows)).collect()
    assert sum(r.text == "five words are in here" for r in kept) == 1
    assert sum(not gram_set(r.text) for r in kept) == sum(not gram_set(t) for _, t in rows)
    assert set_join.op4(spark, documents([(1, "x")]).where("doc_id > 1")).collect() == []


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + rng.randrange(1, 500)) for _ in range(300)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    links = [e for e in edges if e[0] != e[1]]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == roots(nodes, links)
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# Lines

BLANK = " \t\n\x0b\x0c\r"


def runs(line):
    line = line.lower()
    return frozenset(line[i : i + 5] for i in range(max(1, len(line) - 4)))


def line_roots(lines):
    """Root of every line, all pairs compared."""
    sets = {line: runs(line) for line in lines}
    near = [(a, b) for (a, x), (b, y) in itertools.combinations(sets.items(), 2) if 9 * len(x & y) >= 4 * (len(x) + len(y))]
    return roots(list(sets), near), near


def brute_lines(rows):
    """Kept text of each row (unique ids)."""
    lines = {line.strip(BLANK): None for _, text in rows for line in (text or "").split("\n") if line.strip(BLANK)}
    root, _ = line_roots(lines)
    seen, out = set(), {}
    for i, text in sorted(rows):
        kept = []
        for line in (text or "").split("\n"):
            key = line.strip(BLANK)
            if key:
                if root[key] in seen:
                    continue
                seen.add(root[key])
            kept.append(line)
        out[i] = None if text is None else "\n".join(kept)
    return out


def line_corpus(seed=1):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORD) + rng.choice("abcdefgh") for _ in range(rng.randrange(30, 90))) for _ in range(30)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            words = rng.choice(base).split(" ")
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = f"edit{rng.randrange(999)}"
            lines.append(rng.choice(["", " "]) + " ".join(words) if rng.random() < 0.8 else " ".join(rng.choice(WORD) for _ in range(rng.randrange(1, 40))))
        rows.append((i, "\n".join(lines + [""] * rng.randrange(3))))
    return rows


def test_lines_as_brute_force(spark, documents):
    rows = line_corpus() + [(500, None), (501, ""), (502, "\n \n"), (503, "short"), (504, "short\nSHORT")]
    out = {r.doc_id: r for r in line_dedup.marked(spark, documents(rows, 5)).collect()}
    want = brute_lines(rows)
    assert {i: r.text for i, r in out.items()} == want
    count = lambda t: sum(bool(line.strip(BLANK)) for line in (t or "").split("\n"))
    assert all(r.n_kept == count(want[i]) for i, r in out.items())


def as_lines(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "line string").selectExpr("line", "xxhash64(line) AS lid")


def near(spark, texts):
    """Lines -> root by the operator."""
    lines = as_lines(spark, texts)
    of = {r.lid: r.line for r in lines.collect()}
    found = {of[r.node]: of[r.root] for r in line_dedup.near_lines(spark, lines).collect()}
    return {t: found.get(t, t) for t in texts}


def misspelt(rng, text):
    at = rng.randrange(len(text))
    return text[:at] + rng.choice("abcdefgh") + text[at + 1 :]


def test_one_letter_edits_of_short_lines(spark):
    """Lines of 3 to 20 words with one letter changed are linked wherever their similarity is 4/5."""
    rng = random.Random(12)
    base = [" ".join(rng.choice(WORD) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(3, 21))) for _ in range(600)]
    base = list(dict.fromkeys(base))
    pairs = [(t, misspelt(rng, t)) for t in base]
    texts = list(dict.fromkeys(t for p in pairs for t in p))
    got = near(spark, texts)
    want, _ = line_roots(texts)
    close = [(a, b) for a, b in pairs if a != b and 9 * len(runs(a) & runs(b)) >= 4 * (len(runs(a)) + len(runs(b)))]
    assert len(close) > 300 and np.mean([got[a] == got[b] for a, b in close]) > 0.97
    # Nothing is linked that is not.
    joined = {}
    for t in texts:
        joined.setdefault(got[t], set()).add(want[t])
    assert all(len(x) == 1 for x in joined.values())


def test_lines_of_case_and_few_characters(spark):
    texts = ["Read more", "READ MORE", "read  more", "den.", "Den.", "a", "A", "ab", "日本語", "Σς", "σς"]
    got = near(spark, texts)
    assert got["Read more"] == got["READ MORE"] and got["den."] == got["Den."] and got["a"] == got["A"] != got["ab"] and got["日本語"] == "日本語"


def test_large_buckets(spark, monkeypatch):
    """Crowds in blocks: what the head does not settle is compared as a whole."""
    monkeypatch.setattr(line_dedup, "SMALL", 2)
    monkeypatch.setattr(line_dedup, "CHUNK", 16)
    rng = random.Random(4)
    template = " ".join(rng.choice(WORD) for _ in range(24))
    texts = list(dict.fromkeys(f"{template} {rng.choice(WORD)} {rng.choice(WORD)} {rng.choice(WORD)} {i % 40:03d} {rng.choice('abc') * 9}" for i in range(300)))
    want, close = line_roots(texts)
    got = near(spark, texts)
    assert len(close) > 100 and np.mean([got[a] == got[b] for a, b in close]) > 0.95
    joined = {}
    for t in texts:
        joined.setdefault(got[t], set()).add(want[t])
    assert all(len(x) == 1 for x in joined.values())


def test_all_of_one_bucket_are_compared(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK", 16)
    rng = random.Random(6)
    base = [[rng.choice(WORD) + rng.choice("abcdefgh") for _ in range(50)] for _ in range(40)]
    texts = [" ".join(x) for words in base for x in (words, [*words[:20], "edited", *words[21:]])]
    lines = as_lines(spark, texts)
    one = lines.selectExpr("1L AS key", "lid", "80L AS size", "min(lid) OVER () AS head")
    monkeypatch.setattr(line_dedup, "_buckets", lambda *_: one)
    got = line_dedup.near_lines(spark, lines).collect()
    assert len(got) == 80 and len({r.root for r in got}) == 40


def test_shingles_are_the_runs():
    texts = ["abcdefg", "ab", "é🙂xyz12", "ABCDEFG", "a" * 50, "x"]
    h, counts = line_dedup.shingles(texts)
    parts = [set(x.tolist()) for x in np.split(h, np.cumsum(counts)[:-1])]
    assert [len(p) for p in parts] == [len(runs(t)) for t in texts] and parts[0] == parts[3]
    assert len(set().union(*parts)) == len(frozenset().union(*[runs(t) for t in texts]))


def test_lines_are_compared_without_python(spark, documents, monkeypatch):
    """Every table the operator writes, and its result, comes from DataFrame operations alone."""
    plans, written = [], line_dedup.written

    def noted(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, *rest)

    monkeypatch.setattr(line_dedup, "written", noted)
    rows = [(1, "one line of some words that is long enough to have windows of its own, more than eighty characters\nshort"), (2, "one line of some words that is long enough to have windows of its own, more than eighty charactexs\nSHORT")]
    out = line_dedup.marked(spark, documents(rows))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {r.doc_id: r.n_kept for r in out.collect()} == {1: 2, 2: 0}
    assert len(plans) > 10 and not [p for p in plans if any(x in p for x in ("Python", "Pandas", "Arrow"))]


def test_work_tables_go_when_they_have_been_read(spark, documents, monkeypatch):
    """Only what the result reads stays in the shared folder."""
    made, written = [], line_dedup.written

    def noted(df, session, purpose):
        out = written(df, session, purpose)
        made.append((purpose, Path(out.inputFiles()[0].removeprefix("file:")).parent))
        return out

    monkeypatch.setattr(line_dedup, "written", noted)
    monkeypatch.setattr(components, "written", noted)
    rows = line_corpus(3)
    out = line_dedup.marked(spark, documents(rows))
    assert len(made) > 10 and sorted(purpose for purpose, folder in made if folder.exists()) == ["copies", "drops"]
    assert {r.doc_id: r.text for r in out.collect()} == brute_lines(rows)


def test_shuffle_files_go_with_their_query(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+[.]data", manager.getAllFiles().mkString(" ")))
    before, setting = files(), spark.conf.get(SHUFFLE_CLEANUP, None)
    out = written(spark.range(1000).selectExpr("id % 100 AS k").groupBy("k").count(), spark, "counts")
    until = time.monotonic() + 20
    while files() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not files() - before and out.count() == 100 and spark.conf.get(SHUFFLE_CLEANUP, None) == setting


def test_only_work_tables_are_discarded(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "given"))
    given = spark.read.parquet(str(tmp_path / "given"))
    work = written(given, spark, "a copy")
    discard(spark, given, work)
    assert given.count() == 3 and not Path(work.inputFiles()[0].removeprefix("file:")).exists()


def test_very_long_lines(spark, documents):
    rng = random.Random(3)
    long = "".join(chr(rng.randrange(97, 160)) for _ in range(1_500_000))
    rows = [(1, long), (2, long[:700_000] + "another" + long[700_000:]), (3, long[:700_000]), (4, "x\n" * 200_000)]
    out = {r.doc_id: (r.n_lines, r.n_kept) for r in line_dedup.marked(spark, documents(rows)).collect()}
    assert out == {1: (1, 1), 2: (1, 0), 3: (1, 1), 4: (200_000, 1)}


def test_lines_of_awkward_rows(spark, documents):
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(None, "last of all"), (90, "last of all"), (91, "same\nsame"), (91, "same\nsame"), (91, "same\nsame")]
    docs = documents(rows).withColumnRenamed("lang", "n_kept").withColumnRenamed("source", "drops")
    out = line_dedup.marked(spark, docs)
    got = out.collect()
    assert len(got) == len(rows) and set(out.columns) == set(docs.columns) | {"n_lines", "n_kept"}
    assert [r.n_kept for r in got if r.doc_id is None] == [0] and sorted(r.n_kept for r in got if r.doc_id == 91) == [0, 0, 1]
    kept = line_dedup.keep_lines(spark, documents(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sum(r.doc_id == 91 for r in kept.collect()) == 1 and all(r.n_chars == len(r.text) for r in kept.where("doc_id < 80 and text is not null").collect())
    assert line_dedup.op2(spark, documents([(1, "x")]).where("doc_id > 1")).collect() == []


# Benchmark tiles

def brute_tiles(item, doc, minimum):
    """Greedy string tiling by the definition: mark the longest match of unmarked words, again and again."""
    ui, ud, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not ui[i + k] and not ud[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < minimum:
            return out
        for x in range(k):
            ui[i + x] = ud[j + x] = True
        out.append((i, j, k))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.lists(st.integers(1, 4), max_size=90), st.integers(1, 5))
def test_tiles_by_the_definition(item, doc, minimum):
    got = tiling.tile(np.array(item, np.uint64), np.array(doc, np.uint64), minimum)
    assert got == brute_tiles(item, doc, minimum)


def test_long_tiles():
    rng = np.random.default_rng(5)
    item = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    doc = np.concatenate([rng.integers(0, 1 << 60, 50).astype(np.uint64), item[150:], rng.integers(0, 9, 7).astype(np.uint64), item[:150]])
    assert tiling.tile(item, doc) == [(0, 207, 150), (150, 50, 150)]


def passage(rng, n):
    return [rng.choice(WORD) for _ in range(n)]


def test_leaks(spark, documents):
    rng = random.Random(4)
    items = [passage(rng, n) for n in (40, 30, 25, 3, 60)]
    text = " ".join
    filler = lambda: passage(rng, 30)
    rows = [
        (1, text(filler() + items[0] + filler())), (2, text(filler())), (3, text(items[1][15:] + filler() + items[1][:15])),  # reordered
        (4, text(items[2][:10] + filler())), (5, text(filler() + items[3])), (6, text(items[0] + items[1])), (7, None), (8, ""), (None, text(items[4])),
        (9, text(items[4]).upper().replace(" ", ", ")), (9, text(items[4])),
    ]
    benchmark = spark.createDataFrame([(k, text(w)) for k, w in enumerate(items)] + [(50, None), (51, " "), (0, text(items[0]))], "item_id long, text string")
    got = sorted(((r.doc_id or 0), r.item_id, round(r.coverage, 3)) for r in tiling.op5(documents(rows), benchmark).collect())
    assert got == [(0, 4, 1.0), (1, 0, 1.0), (1, 0, 1.0), (3, 1, 1.0), (5, 3, 1.0), (6, 0, 1.0), (6, 0, 1.0), (6, 1, 1.0), (9, 4, 1.0), (9, 4, 1.0)]
    assert {r.doc_id for r in tiling.clean(documents(rows), benchmark).collect()} == {2, 4, 7, 8}
    none = benchmark.where("item_id > 99")
    assert tiling.op5(documents(rows), none).collect() == [] and tiling.clean(documents(rows), none).count() == len(rows)


def test_leaks_in_blocks(spark, documents, monkeypatch):
    docs, benchmark = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    whole = sorted(map(tuple, tiling.op5(docs, benchmark).collect()))
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 700)
    assert sorted(map(tuple, tiling.op5(docs, benchmark).collect())) == whole and whole


def test_leaks_as_brute_force(spark):
    docs, benchmark = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(t))
    want = set()
    for r in docs.collect():
        d = words(r.text)
        for b in benchmark.collect():
            w = words(b.text)
            seeds = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
            if any(tuple(d[k : k + 5]) in seeds for k in range(len(d) - 4)):
                code = {x: n for n, x in enumerate(set(w) | set(d))}
                share = sum(t[2] for t in brute_tiles([code[x] for x in w], [code[x] for x in d], 5)) / len(w)
                if share >= tiling.COVERAGE:
                    want.add((r.doc_id, b.item_id))
    assert {(r.doc_id, r.item_id) for r in tiling.op5(docs, benchmark).collect()} == want


# The pipeline

def test_pipeline_as_brute_force(spark):
    import corpus_pipeline as p

    from fleetspark.llm import quality
    from fleetspark.llm.tables import written

    docs = table(spark, SMALL, "documents")
    names = [n for n, _ in p.STAGES]
    assert len(names) == 5
    seen = [docs]
    for name, stage in p.STAGES:
        seen.append(written(stage(spark, seen[-1], SMALL), spark, name))
    rows = [sorted((r.doc_id, r.text) for r in d.collect()) for d in seen]
    good = {r.doc_id for r in quality.op1(spark, docs, table(spark, SMALL, "labels")).where("predicted = 1").collect()}
    assert {i for i, _ in rows[1]} == good and set(rows[1]) <= set(rows[0])
    lines = brute_lines(rows[1])
    assert dict(rows[2]) == {i: t for i, t in lines.items() if t.strip(BLANK) or not dict(rows[1])[i].strip(BLANK)}
    classes = brute_classes(rows[2])
    assert {i for i, _ in rows[3]} == {c for c, _, _ in classes.values()}
    leaked = {r.doc_id for r in tiling.op5(seen[3], table(spark, SMALL, "benchmark")).collect()}
    assert {i for i, _ in rows[4]} == {i for i, _ in rows[3]} - leaked and leaked
    assert rows[5] == rows[4] and seen[5].where("NOT intact OR n_tokens <> size(ids)").count() == 0
    for d in seen[1:5]:
        assert d.columns == docs.columns


def test_pipeline_of_no_rows(spark, tmp_path):
    import corpus_pipeline as p

    for name in ("documents", "labels", "benchmark"):
        table(spark, SMALL, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, f"file://{tmp_path}").collect() == []


def test_pipeline_on_awkward_rows(spark, tmp_path, documents):
    import corpus_pipeline as p

    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(None, "no id"), (3, "twice"), (3, "twice")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SMALL, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = p.run(spark, f"file://{tmp_path}")
    assert out.where("NOT intact").count() == 0 and out.where("text = 'twice'").count() == 1


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_other_columns(spark, documents, stage):
    import corpus_pipeline as p

    docs = documents([(1, "some words of a text that stays here"), (2, None)]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "__rk2")
    out = p.STAGES[stage][1](spark, docs, SMALL)
    assert out.columns == docs.columns and out.count() == 2


def test_reachable_words_bound_the_tiles():
    rng = random.Random(5)
    for _ in range(200):
        item, doc = (np.array([rng.randrange(4) for _ in range(n)], np.uint64) for n in (rng.randrange(1, 30), rng.randrange(0, 60)))
        size = min(tiling.MIN_WORDS, len(item))
        most = tiling.reachable(item, np.sort(tiling._seeds(doc, size)), size)
        covered = sum(t[2] for t in tiling.tile(item, doc, size))
        assert covered <= most <= len(item) and (most > 0) == (covered > 0)


def test_settled_buckets_are_told_from_others():
    """A chunk whose sets its samples link to one group is settled; every other bucket goes on."""
    rng = np.random.default_rng(0)
    one, two, three = (rng.integers(0, 1 << 32, set_join.TOKENS, dtype=np.uint64).astype(np.uint32) for _ in range(3))
    near = one.copy()
    near[:10] += 1
    rows = [(5, 0, one, True), (5, 0, near, False), (5, 0, one, False), (5, 1, one, True), (5, 1, near, False),
            (6, 0, one, True), (6, 0, two, False), (7, 0, two, True), (7, 0, one, True), (7, 0, near, False), (7, 0, three, False)]
    batch = pa.table({
        "path": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([r[1] for r in rows], pa.int32()),
        "set_key": pa.array([bytes([i]) for i in range(len(rows))]), "sketch": pa.array([r[2].tobytes() for r in rows]), "sample": [r[3] for r in rows],
    }).to_batches()
    out = pa.Table.from_batches(list(set_join._with_samples(iter(batch)))).to_pylist()
    assert [r["path"] for r in out if r["path"] is not None] == [6, 7]
    linked = {(r["a"], r["b"]) for r in out if r["path"] is None}
    assert {(bytes([1]), bytes([0])), (bytes([2]), bytes([0])), (bytes([4]), bytes([3])), (bytes([9]), bytes([8]))} == linked


def test_row_keys_tell_nulls_of_neighbouring_columns(spark):
    rows = [(1, "the same text", None, "en"), (1, "the same text", "en", None), (1, "the same text", None, None), (1, "the same text", None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a string, b string")
    from fleetspark.llm.tables import row_key

    assert docs.select(row_key(docs)).distinct().count() == 3
    marked = line_dedup.marked(spark, docs).select("doc_id", "a", "b").collect()
    assert sorted(map(str, marked)) == sorted(map(str, docs.select("doc_id", "a", "b").collect()))
    kept = set_join.keep_first(spark, docs.union(spark.createDataFrame([(2, "another text altogether, with words", None, "en")], docs.schema))).collect()
    assert len(kept) == 2 and (2, None, "en") in {(r["doc_id"], r["a"], r["b"]) for r in kept}


def test_buckets_that_other_trees_settle_go_no_deeper(spark):
    a, b, c = (bytes([i]) * 16 for i in (1, 2, 3))
    large = spark.createDataFrame([(1, bytearray(a)), (1, bytearray(b)), (2, bytearray(a)), (2, bytearray(c)), (3, bytearray(b)), (3, bytearray(c))], "path long, set_key binary")
    roots = spark.createDataFrame([(bytearray(b), bytearray(a)), (bytearray(a), bytearray(a))], "node binary, root binary")
    paths = spark.createDataFrame([(1,), (2,)], "path long")
    # 1 is one component; 2 has a set of its own; 3 was settled by its samples.
    assert [r.path for r in set_join._unsettled(large, paths, roots).collect()] == [2]


def test_few_outliers_are_compared_instead_of_going_deeper(spark, documents, monkeypatch):
    monkeypatch.setattr(set_join, "CHUNK", 32)  # several chunks a bucket
    levels, write = [], set_join.written

    def written(df, spark, purpose):
        out = write(df, spark, purpose)
        levels.extend([out.count()] if purpose == "level" else [])
        return out

    monkeypatch.setattr(set_join, "written", written)
    rows = near_corpus(5)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in set_join.op4(spark, documents(rows, 7)).collect()}
    assert got == brute_classes(rows) and len(levels) == 1


def test_outliers_meet_all_members_of_their_chunk():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 32, (6, set_join.TOKENS), dtype=np.uint64).astype(np.uint32)
    near = base.copy()
    near[:, : set_join.TOKENS - set_join.LOOSE] += 1
    far = base.copy()
    far[:, : set_join.TOKENS - set_join.LOOSE + 1] += 256  # the lowest bytes agree, one token too few does
    members, samples = [*near, *far], [*base]
    sketches = [(0, x, False) for x in members] + [(0, x, True) for x in samples] + [(1, x, False) for x in members]
    batch = pa.table({
        "path": pa.array([9] * len(sketches), pa.int64()), "chunk": pa.array([c for c, _, _ in sketches], pa.int32()),
        "set_key": pa.array([bytes([i]) for i in range(len(sketches))]), "sketch": pa.array([x.tobytes() for _, x, _ in sketches]), "sample": [s for _, _, s in sketches],
    }).to_batches()
    out = pa.Table.from_batches(list(set_join._with_outliers(iter(batch)))).to_pylist()
    assert {(r["a"], r["b"]) for r in out} == {(bytes([12 + i]), bytes([i])) for i in range(6)}


def peak_mb(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1] / (1 << 20)
    finally:
        tracemalloc.stop()


def test_chunks_are_compared_with_each_other_only():
    """Links and components between two chunks as by brute force, in the memory of one rectangle."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, (40, 60)).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.08, rng.integers(0, 1 << 62, 60).astype(np.uint64), base[i % 40])) for i in range(1200)]
    chunk = rng.integers(4, 6, len(sets))
    (links, label), peak = peak_mb(lambda: set_join._links(sets, chunk, True))
    of = [set(x.tolist()) for x in sets]
    near = [(a, b) for a, b in itertools.combinations(range(1200), 2) if a % 40 == b % 40 and chunk[a] != chunk[b] and 9 * len(of[a] & of[b]) >= 4 * (len(of[a]) + len(of[b]))]
    counts = np.bincount(np.array(near).ravel(), minlength=1200)
    root = roots(range(1200), near)
    assert len(near) > 1000 and (links == counts).all() and label.tolist() == [root[i] for i in range(1200)] and peak < 24


def test_sketching_takes_little_memory():
    texts = [" ".join(f"w{i * 7 + k}" for k in range(400)) for i in range(400)]
    batch = pa.table({"doc_id": list(range(400)), "text": texts, "row_key": [bytes([1])] * 400}).to_batches()[0]
    out, peak = peak_mb(lambda: list(set_join._keyed([batch])))
    assert out[0].num_rows == 400 and peak < 22


def test_good_documents_come_back_in_parts(spark, documents):
    from fleetspark.llm import quality

    rng = np.random.default_rng(2)
    weights = np.append(rng.normal(size=1 << quality.BITS), 0.0)
    docs = documents([(i, f"text w{i} of x{i % 13}") for i in range(1300)], 1)
    want = {r.doc_id for r in quality.score(docs, weights).where("quality_ok").collect()}
    assert 0 < len(want) < 1300 and {r.doc_id for r in quality.accepted(docs, weights).collect()} == want
