"""Alignment against whole texts, token by token, with plain counting."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import AWKWARD, documents  # noqa: F401
from tokenizers import Tokenizer

from fleetspark.llm import pair_bitmaps
from fleetspark.llm.tables import table

SMALL = "/root/testdata/sf0.001"


class Whole:
    """Both tokenizers on whole texts, offsets by the token's own bytes."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}

    def tokens(self, text):
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
        same = all(b"".join(x for _, x in t) == (" " + text).encode() for t in (a, b))
        return (a, b) if text and same else ([], [])

    def one(self, text):
        """(n_a, n_b, groups, links)"""
        a, b = self.tokens(text or "")
        ends = lambda t: dict(zip(np.cumsum([len(x) for _, x in t]).tolist(), range(len(t))))
        ends_a, ends_b = ends(a), ends(b)
        groups, links, s, t = [], [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a[e], ends_b[e]
            groups.append(",".join(str(x) for x, _ in a[s:i + 1]) + "|" + ",".join(str(x) for x, _ in b[t:j + 1]))
            links.append((a[i][0], b[j][0]))
            s, t = i + 1, j + 1
        return len(a), len(b), ";".join(groups), links


@pytest.fixture(scope="module")
def whole():
    return Whole()


@pytest.fixture(scope="module")
def aligner():
    return pair_bitmaps.Aligner(*pair_bitmaps.vocabulary_paths())


def brute(whole, rows):
    found = [(i, *whole.one(t)) for i, t in rows]
    count, documents_ = Counter(x for *_, links in found for x in links), Counter(x for *_, links in found for x in set(links))
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return Counter(
        (i, n_a, n_b, len(links), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
         hashlib.sha256(groups.encode()).hexdigest() if n_a else "", sum(documents_[x] for x in links))
        for i, n_a, n_b, groups, links in found
    )


@pytest.mark.parametrize("text", [t for t in AWKWARD if t] + ["a\t  b", "a \n b", "x  y", "x　\ny", "▁", "a▁b", "<0x0A>", "<s> </s><unk>", "a\r\n  b\x85 c\x1c d", "  two", "᠎ z"])
def test_parts_give_the_whole_texts_tokens(aligner, whole, text):
    n_a, n_b, groups, links = whole.one(text)
    got = aligner.align([text])[0]
    assert aligner.in_parts
    assert got[:3] == (n_a, n_b, groups.encode()) and got[3].tolist() == [a << 32 | b for a, b in links]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet=" \n\t\r 'sterdé.!\x1c1", max_size=60)))
def test_any_text(aligner, whole, text):
    n_a, n_b, groups, _ = whole.one(text)
    assert aligner.align([text])[0][:3] == (n_a, n_b, groups.encode())


def test_given_documents(spark, whole):
    docs = table(spark, SMALL, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, pair_bitmaps.op13(docs).collect())) == brute(whole, rows)


def test_containers_planes_and_odd_rows(spark, documents, whole, monkeypatch):
    monkeypatch.setattr(pair_bitmaps, "CONTAINER_DOCS", 40)
    monkeypatch.setattr(pair_bitmaps, "CONTAINER_LINKS", 500)
    monkeypatch.setattr(pair_bitmaps, "MEMORY_BYTES", 2000)
    rng = np.random.default_rng(4)
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(None, "no id"), (3, "twice"), (3, "twice")]
    rows += [(100 + i, " ".join(rng.choice(["the", "river", "stone-age", "über", "naïve"], int(rng.integers(0, 60))))) for i in range(300)]
    docs = documents(rows).selectExpr("*", "1 AS container", "2 AS pair", "3 AS links", "'x' AS docs", "4 AS n")
    assert Counter(map(tuple, pair_bitmaps.op13(docs).collect())) == brute(whole, rows)


def test_long_texts(spark, documents, whole):
    rows = [(1, "z" * 1_200_000), (2, "the river " * 150_000), (3, "the river")]
    assert Counter(map(tuple, pair_bitmaps.op13(documents(rows)).collect())) == brute(whole, rows)


def test_empty_table(spark, documents):
    assert pair_bitmaps.op13(documents([(1, "x")]).limit(0)).collect() == []
    assert [tuple(r) for r in pair_bitmaps.op13(documents([(1, None), (2, "")])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", 0), (2, 0, 0, 0, 0, 0, 0, "", 0)]


def test_pair_counts(spark, documents, whole):
    rows = [(i, t) for i, t in enumerate(["a b a b", "b c", "a a a"])]
    count, of = Counter(), Counter()
    for _, t in rows:
        links = whole.one(t)[3]
        count.update(links)
        of.update(set(links))
    got = pair_bitmaps.pair_counts(pair_bitmaps.index(documents(rows)))
    got = {(r[0], r[1]): (r[2], r[3]) for r in got.select(pair_bitmaps.id_a(got["pair"]), pair_bitmaps.id_b(got["pair"]), "documents", "links").collect()}
    assert got == {x: (of[x], count[x]) for x in count}


def test_postings_hold_every_number():
    """Lists and bitmaps, all planes."""
    rng = np.random.default_rng(0)
    times = rng.integers(0, 9, (6, 50)) * (rng.random((6, 50)) < np.array([[0.02], [0.1], [0.5], [0.9], [1], [0]]))
    pairs, local = np.nonzero(times)
    rows = pair_bitmaps.postings(pairs, local, times[pairs, local], 50)
    back = np.zeros_like(times)
    at, doc = pair_bitmaps.documents_of(rows)
    np.add.at(back, (rows.column("pair").to_numpy()[at], doc), rows.column("weight").to_numpy()[at])
    assert (back == times).all() and set(rows.column("dense").to_pylist()) == {True, False}
    present = rows.filter(rows.column("present"))
    assert dict(zip(present.column("pair").to_pylist(), present.column("n").to_pylist())) == {p: n for p, n in enumerate((times > 0).sum(axis=1)) if n}
