"""Token operators against the tokenizers library."""

import hashlib
import inspect
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetspark.llm import bpe, token_store
from llm_cases import AWKWARD, SMALL, documents  # noqa: F401


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("text", [t for t in AWKWARD if t])
def test_encode_awkward(codec, byte_library, text):
    ids = byte_library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text).tolist() == ids
    assert codec.decode(np.array(ids)) == byte_library.decode(ids, skip_special_tokens=False).encode()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t'sterdvlmaéß1.!\x1c ", max_size=60), st.text(alphabet="abetinorsh ", max_size=80)))
def test_encode_any_text(codec, byte_library, text):
    ids = byte_library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text).tolist() == ids
    assert codec.decode(codec.encode(text)).decode() == byte_library.decode(ids, skip_special_tokens=False)


def test_decode_of_cut_characters(codec, byte_library):
    ids = byte_library.encode("日本🙂", add_special_tokens=False).ids
    for cut in range(1, len(ids)):
        assert codec.decode(np.array(ids[cut:])).decode() == byte_library.decode(ids[cut:], skip_special_tokens=False)


def test_round_trip_query(spark, documents, byte_library):
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(None, "none"), (3, "twice"), (3, "twice")]
    out = sorted(map(tuple, bpe.op7(documents(rows)).collect()), key=str)

    def one(i, t):
        ids = byte_library.encode(t or "", add_special_tokens=False).ids
        decoded = byte_library.decode(ids, skip_special_tokens=False)
        return (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())

    assert out == sorted((one(i, t) for i, t in rows), key=str)


def test_round_trip_whole_table(spark, byte_library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r.ids_sha256 for r in bpe.op7(docs).collect()}
    for r in docs.collect():
        ids = byte_library.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_tokens_keep_columns(documents):
    out = bpe.tokens(documents([(1, "Hello there"), (2, None)]).withColumnRenamed("source", "IDS")).collect()
    assert {r.decoded for r in out} == {"Hello there", ""}
    assert all("lang" in r.asDict() for r in out)


@pytest.mark.parametrize("unit", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 65536])
def test_planes(unit, n):
    ids = np.random.default_rng(n).integers(0, 49408, n).astype("<u4")
    width, planes = token_store.to_planes(ids, unit)
    assert token_store.from_planes(n, width, planes).tolist() == ids.tolist()


def expected(rows, library):
    """Rows of the store by one pass in order; ties by value need no order here."""
    out, start = [], 0
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_store_whole_table(spark, word_library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(map(tuple, token_store.op3(spark, docs).collect())) == expected(rows, word_library)


def test_store_awkward(spark, documents, word_library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK", 64)  # most documents lie in several blocks
    rows = [(i, t) for i, t in enumerate(AWKWARD)]
    out = sorted(map(tuple, token_store.op3(spark, documents(rows, 5)).collect()))
    assert out == expected(rows, word_library)


def test_store_ties_nulls_and_empty(spark, documents, word_library):
    rows = [(None, "null id"), (5, "same"), (5, "same"), (5, None), (4, "before")]
    out = sorted(map(tuple, token_store.op3(spark, documents(rows)).collect()), key=lambda r: r[1])
    assert [r[0] for r in out] == [None, 4, 5, 5, 5]
    assert all(a[1] + a[2] == b[1] for a, b in zip(out, out[1:]))
    assert token_store.op3(spark, documents([(1, "x")]).where("doc_id > 1")).collect() == []


def test_store_returns_ids(spark, documents, word_library, tmp_path):
    folder = f"file://{tmp_path}/store"
    token_store.write(documents([(1, "The cat sat"), (0, "on it")]), folder, unit="byte")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_store.read(spark, folder, with_ids=True).collect()}
    assert got[1] == word_library.encode("The cat sat", add_special_tokens=False).ids + [2]
    assert spark.read.parquet(f"{folder}/index").agg({"n_ids": "sum"}).collect()[0][0] == sum(map(len, got.values()))


def test_long_parts_are_not_remembered(codec, byte_library, word_library):
    """Megabytes without a blank are encoded, and leave nothing behind."""
    text = "x" * 300_000 + " " + "ab" * 200_000 + " word"
    assert codec.encode(text).tolist() == byte_library.encode(text, add_special_tokens=False).ids
    assert max(map(len, codec._pieces)) <= bpe.LONGEST and max(map(len, codec._parts)) <= bpe.LONGEST
    encode = token_store._encoder(token_store.vocabulary_path())
    assert [np.frombuffer(x, "<u4").tolist() for x in encode([text, "word"])] == [word_library.encode(t, add_special_tokens=False).ids for t in (text, "word")]
    held = dict(zip(encode.__code__.co_freevars, [c.cell_contents for c in encode.__closure__]))
    assert "word" in held["memory"] and max(map(len, held["memory"])) <= token_store.LONGEST
    assert max(map(len, inspect.getclosurevars(held["learn"]).nonlocals["pieces"])) <= token_store.LONGEST


def test_plain_words_skip_normalizer_and_pattern(word_library, monkeypatch):
    """Words and marks go to the vocabulary's model, only other parts through the whole library, with equal ids."""
    import tokenizers

    sent = []

    class Noted:
        def __init__(self, tokenizer):
            self._tokenizer = tokenizer

        @staticmethod
        def from_file(path):
            return Noted(Tokenizer.from_file(path))

        def __getattr__(self, name):
            return getattr(self._tokenizer, name)

        def encode_batch_fast(self, texts, **kw):
            sent.extend(texts)
            return self._tokenizer.encode_batch_fast(texts, **kw)

    monkeypatch.setattr(tokenizers, "Tokenizer", Noted)
    encode = token_store._encoder(token_store.vocabulary_path())
    letters = "".join(chr(c) for c in range(256) if chr(c).isalpha())
    texts = [f"Überraschung, naïve CAFÉ... end!\n{letters} ß\nÀÉÎ); x", "don't 1,234 日本 été <|endoftext|> a_b", "", "\n  \n", "µm ªº"]
    got = [np.frombuffer(x, "<u4").tolist() for x in encode(texts)]
    assert got == [word_library.encode(t, add_special_tokens=False).ids for t in texts]
    assert not {"überraschung", "Überraschung,", "naïve", "café", "CAFÉ...", "end", "!", "ÀÉÎ);"} & set(sent)


@pytest.fixture(scope="module")
def store_encode():
    return token_store._encoder(token_store.vocabulary_path())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZéÉßþÞÿ×÷'!.<|> \n\t1_µ", max_size=40), max_size=4))
def test_store_encoder_any_text(store_encode, word_library, texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in store_encode(texts)] == [word_library.encode(t, add_special_tokens=False).ids for t in texts]
