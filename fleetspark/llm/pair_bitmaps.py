"""Alignment of two tokenizers: which ids end together, how often in the whole corpus.

Both token sequences of a text cover the same bytes.  Offsets where both have a token end cut them
into groups, and link the two tokens that end there.  Links are kept as an inverted index: per pair
of ids and container of documents a bitmap of the documents that have it, and bitmaps (planes) of
the binary digits of how much more often than once.  Bitmaps with few documents are lists of their
numbers.  Containers hold different documents, so the OR of a pair's bitmaps has the sum of their
popcounts: that gives documents and links of a pair.  The postings then lead these back to the
documents.
"""

from __future__ import annotations

import array
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspark.llm.bpe import byte_alphabet
from fleetspark.llm.tables import small, written

#: Documents and links of a container at most; a document alone may have more links.
CONTAINER_DOCS, CONTAINER_LINKS = 4096, 1 << 21
#: Bytes of results that a task remembers between batches; more are forgotten, which changes no result.
MEMORY_BYTES = 128 << 20
#: Characters aligned at once.
SLICE = 1 << 20
#: Characters of new parts that are encoded in a row.
ROW = 1 << 14
#: A pair of ids as one number.
SHIFT = 32

# A blank or line end after a character that no kind of white space is, in any version of Unicode.
_ODD = "\u180e\u200b\ufeff"
_CUT = re.compile(f"(?<=[^\\s{_ODD}])(?=[ \n])")


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Aligns texts by a byte-level BPE file (A) and a piece model with byte fallback (B).

    Where neither vocabulary has a token that goes from a character on into a following blank or line
    end, texts are cut there and equal parts are aligned once; else texts are aligned as a whole.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        self.bytes_a: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in spec["model"]["vocab"].items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.b.piece_to_id("▁")
        before = spec.get("pre_tokenizer") or {}
        self.in_parts = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
            and not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces) and self.b.encode("\n a") == [self.blank, *self.b.encode("\n a")[1:]]
        )
        self.sizes_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)], np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.written = [f"{i}{mark}".encode() for i in range(len(self.sizes_a)) for mark in ",|"] + [f"{i}{mark}".encode() for i in range(len(pieces)) for mark in ",;\n"]
        self.forget()

    def forget(self) -> None:
        # Place 0 stands for parts whose tokens do not give the text back.
        self.memory: dict[str, int] = {}
        self.groups: list[bytes] = [b""]
        self.links: list[bytes] = [b""]
        self.counts = array.array("q", [0, 0])
        self.held = 0

    def parts(self, text: str) -> list[str]:
        return _CUT.split(" " + text) if self.in_parts else [" " + text]

    def learn(self, parts: list[str]) -> None:
        """Remember parts.  Those that end in no white space are cut from each other when put in a row, too."""
        if self.in_parts:
            row, size = [], 0
            for part in parts:
                if part[-1].isspace() or part[-1] in _ODD:
                    self._learn_one(part)
                    continue
                row.append(part)
                size += len(part)
                if size > ROW:
                    self._learn_row(row)
                    row, size = [], 0
            if row:
                self._learn_row(row)
        else:
            for part in parts:
                self._learn_one(part)

    def _tokens(self, text: str) -> tuple[list[int], list[int]]:
        b = [self.blank] if text == " " else self.b.encode(text[1:] if text[0] == " " else text, num_threads=1)
        # The model puts a blank first, and gives nothing for nothing.
        return self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, b if text[0] == " " else b[1:]

    def _learn_one(self, part: str) -> None:
        a, b = self._tokens(part)
        pieces_a, pieces_b, whole = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b], part.encode()
        if b"".join(pieces_a) != whole or b"".join(pieces_b) != whole:
            self.memory[part] = 0
            return
        groups, links = aligned(a, [len(x) for x in pieces_a], b, [len(x) for x in pieces_b])
        self._remember([part], [groups], [np.array(links, np.int64).tobytes()], [len(a), len(b)])

    def _remember(self, parts: list[str], groups: list[bytes], links: list[bytes], counts: list[int]) -> None:
        n = len(self.groups)
        self.memory.update(zip(parts, range(n, n + len(parts))))
        self.groups += groups
        self.links += links
        self.counts.extend(counts)
        self.held += sum(map(len, links)) + sum(map(len, groups)) + 4 * sum(map(len, parts)) + 300 * len(parts)

    def _learn_row(self, parts: list[str]) -> None:
        text = "".join(parts)
        whole = text.encode()
        in_a, in_b = self._tokens(text)
        a, b = np.array(in_a, np.int64), np.array(in_b, np.int64)
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        part_ends = np.cumsum([len(p.encode()) for p in parts])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        same = b"".join([self.bytes_a[i] for i in in_a]) == whole and b"".join([self.bytes_b[i] for i in in_b]) == whole
        if not same or not np.isin(part_ends, ends, assume_unique=True).all():
            # Some part's tokens do not give it back; which, only each by itself tells.
            for part in parts:
                self._learn_one(part)
            return
        group_a, group_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        last_a, last_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        links = (a[last_a] << SHIFT | b[last_b]).astype(np.int64).tobytes()
        # Each token with the mark that follows it, in the order of the groups, written at once.
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[last_a], end_b[last_b] = 1, 1
        upto = np.searchsorted(ends, part_ends, "right")
        end_b[last_b[upto - 1]] = 2
        marks = np.empty(len(a) + len(b), np.int64)
        marks[np.arange(len(a)) + np.append(0, last_b + 1)[group_a]] = 2 * a + end_a
        marks[np.arange(len(b)) + (last_a + 1)[group_b]] = 2 * len(self.sizes_a) + 3 * b + end_b
        written_ = self.written
        groups = b"".join([written_[k] for k in marks.tolist()]).split(b"\n")[:-1]
        cuts = [0, *(8 * upto).tolist()]
        of_a, of_b = np.searchsorted(ends_a, part_ends, "right"), np.searchsorted(ends_b, part_ends, "right")
        counts = np.stack([np.diff(of_a, prepend=0), np.diff(of_b, prepend=0)], axis=1).ravel().tolist()
        self._remember(parts, groups, [links[s:e] for s, e in zip(cuts, cuts[1:])], counts)

    def align(self, texts: list[str]) -> list[tuple[int, int, bytes, np.ndarray]]:
        """Per text the numbers of tokens, the groups written out, and its links as pairs."""
        if self.held > MEMORY_BYTES:
            self.forget()
        split = [self.parts(t) if t else [] for t in texts]
        missing = {p for parts in split for p in parts}
        missing.difference_update(self.memory)
        if missing:
            self.learn(list(missing))
        memory, groups, links = self.memory, self.groups, self.links
        counts = np.array(self.counts).reshape(-1, 2)
        out = []
        for parts in split:
            at = [memory[p] for p in parts]
            if not at or 0 in at:
                out.append((0, 0, b"", np.zeros(0, np.int64)))
                continue
            n_a, n_b = counts.take(at, axis=0).sum(axis=0)
            out.append((int(n_a), int(n_b), b";".join([groups[i] for i in at]), np.frombuffer(b"".join([links[i] for i in at]), np.int64)))
        return out


def aligned(a: list[int], sizes_a: list[int], b: list[int], sizes_b: list[int]) -> tuple[bytes, list[int]]:
    """(groups written out, linked pairs) of two token sequences over the same bytes."""
    groups, links = [], []
    i = j = first_a = first_b = 0
    end_a, end_b = sizes_a[0], sizes_b[0]
    while True:
        if end_a == end_b:
            links.append(a[i] << SHIFT | b[j])
            groups.append(f"{','.join(map(str, a[first_a:i + 1]))}|{','.join(map(str, b[first_b:j + 1]))}")
            i, j = i + 1, j + 1
            if i == len(a):
                return ";".join(groups).encode(), links
            first_a, first_b = i, j
            end_a, end_b = end_a + sizes_a[i], end_b + sizes_b[j]
        elif end_a < end_b:
            i += 1
            end_a += sizes_a[i]
        else:
            j += 1
            end_b += sizes_b[j]


INDEX = "pair long, present boolean, weight long, n long, dense boolean, docs binary"
DOCS = "local int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_DOC_FIELDS = [("local", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_INDEX_FIELDS = [("pair", pa.int64()), ("present", pa.bool_()), ("weight", pa.int64()), ("n", pa.int64()), ("dense", pa.bool_()), ("docs", pa.binary())]


def postings(pairs: np.ndarray, local: np.ndarray, times: np.ndarray, n_docs: int) -> pa.Table:
    """Index rows of a container from its (pair, document, times), sorted by pair and document: a bitmap
    of documents per pair, and one per binary digit of times - 1."""
    tables = []
    for plane in range(-1, max(1, int(times.max())).bit_length() if len(times) else 0):
        weight = 1 << max(plane, 0)
        here = slice(None) if plane < 0 else np.flatnonzero((times - 1) >> plane & 1)
        p, d = pairs[here], local[here].astype("<u2")
        if not len(p):
            continue
        cuts = np.append(np.flatnonzero(np.append(True, p[1:] != p[:-1])), len(p))
        n = np.diff(cuts)
        dense = 2 * n > -(-n_docs // 8)
        raw, offsets = d.tobytes(), 2 * cuts
        docs = [raw[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        for k in np.flatnonzero(dense):
            bits = np.zeros(n_docs, np.uint8)
            bits[d[cuts[k] : cuts[k + 1]]] = 1
            docs[k] = np.packbits(bits).tobytes()
        m = len(n)
        tables.append(pa.Table.from_arrays(
            [pa.array(p[cuts[:-1]]), pa.array(np.full(m, plane < 0)), pa.array(np.full(m, weight, np.int64)), pa.array(n.astype(np.int64)), pa.array(dense), pa.array(docs, pa.binary())],
            schema=pa.schema(_INDEX_FIELDS),
        ))
    return pa.concat_tables(tables) if tables else pa.schema(_INDEX_FIELDS).empty_table()


def documents_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(row of the table, document) of all bits of index rows."""
    n, dense, docs = table.column("n").to_numpy(), table.column("dense").to_numpy(zero_copy_only=False), table.column("docs").combine_chunks()
    lists = np.flatnonzero(~dense)
    row = [np.repeat(lists, n[lists])]
    doc = [np.frombuffer(b"".join(docs.take(pa.array(lists)).to_pylist()), "<u2").astype(np.int64)]
    for k in np.flatnonzero(dense):
        d = np.flatnonzero(np.unpackbits(np.frombuffer(docs[k].as_py(), np.uint8)))
        row.append(np.full(len(d), k))
        doc.append(d)
    return np.concatenate(row), np.concatenate(doc)


def index(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """The written index of ``docs`` (doc_id, text): a row per document (pair is null) and the postings.

    Columns: container, doc_id, those of ``DOCS`` and of ``INDEX``.  Null and empty texts, and those that
    either tokenizer does not give back byte for byte, have no tokens: zeros and ''.
    """
    path_a, path_b = paths or vocabulary_paths()
    doc_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("container", T.LongType()), T.StructField("doc_id", doc_type), *T.StructType.fromDDL(DOCS), *T.StructType.fromDDL(INDEX)])

    def rows(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        aligner = Aligner(path_a, path_b)
        container = TaskContext.get().partitionId() << 33
        ids, facts, found, links = [], [], [], 0

        def cut():
            if found:
                every = [np.unique(x, return_counts=True) for x in found]
                sizes = [len(p) for p, _ in every]
                pairs, times, local = np.concatenate([p for p, _ in every]), np.concatenate([t for _, t in every]), np.repeat(np.arange(len(every)), sizes)
                order = np.argsort(pairs, kind="stable")
                table = postings(pairs[order], local[order], times[order], len(every))
            else:
                table = postings(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
            head = {"container": pa.array(np.full(len(facts), container)), "doc_id": pa.concat_arrays(ids)}
            head |= {name: pa.array([f[k] for f in facts], kind) for k, (name, kind) in enumerate(_DOC_FIELDS)}
            tail = {"container": pa.array(np.full(table.num_rows, container)), "doc_id": pa.nulls(table.num_rows, head["doc_id"].type)}
            names = ["container", "doc_id", *[n for n, _ in _DOC_FIELDS], *[n for n, _ in _INDEX_FIELDS]]
            kinds = {"container": pa.int64(), "doc_id": head["doc_id"].type, **dict(_DOC_FIELDS), **dict(_INDEX_FIELDS)}
            for part, size in ((head, len(facts)), (tail | {n: table.column(n) for n, _ in _INDEX_FIELDS}, table.num_rows)):
                full = pa.table([part[n] if n in part else pa.nulls(size, kinds[n]) for n in names], names=names)
                yield from full.to_batches(max_chunksize=65536)

        for batch in batches:
            column, at = batch.column("text"), 0
            while at < batch.num_rows:
                texts, size, first = [], 0, at
                while at < batch.num_rows and (not texts or size < SLICE) and len(facts) + len(texts) < CONTAINER_DOCS:
                    texts.append(column[at].as_py() or "")
                    size += len(texts[-1])
                    at += 1
                ids.append(batch.column("doc_id").slice(first, at - first))
                for n_a, n_b, groups, pairs in aligner.align(texts):
                    facts.append((len(facts), n_a, n_b, len(pairs), len(pairs), hashlib.sha256(groups).hexdigest() if len(pairs) else ""))
                    found.append(pairs)
                    links += len(pairs)
                if len(facts) >= CONTAINER_DOCS or links >= CONTAINER_LINKS:
                    yield from cut()
                    container, ids, facts, found, links = container + 1, [], [], [], 0
        if facts:
            yield from cut()

    return written(docs.select("doc_id", "text").mapInArrow(rows, schema), docs.sparkSession, "pair-index")


def id_a(pair: Column) -> Column:
    return F.shiftright(pair, SHIFT)


def id_b(pair: Column) -> Column:
    return pair.bitwiseAND(F.lit((1 << SHIFT) - 1))


def pair_counts(index: DataFrame) -> DataFrame:
    """(pair, documents, links, is_best) of every linked pair; best are the pairs whose id of B has no
    pair with more links.  ``id_a`` and ``id_b`` take a pair apart."""
    spark = index.sparkSession
    counts = written(
        index.where("pair IS NOT NULL").groupBy("pair")
        .agg(F.sum(F.when(F.col("present"), F.col("n")).otherwise(0)).alias("documents"), F.sum(F.col("weight") * F.col("n")).alias("links")), spark, "pair-counts",
    )
    # One row per id of B: as many as that vocabulary has.
    most = counts.groupBy(id_b(F.col("pair")).alias("b")).agg(F.max("links").alias("most"))
    most = written(most, spark, "most-links")
    joined = counts.withColumn("b", id_b(F.col("pair"))).join(small(most, most.count(), 64), "b")
    return joined.select("pair", "documents", "links", (F.col("links") == F.col("most")).alias("is_best"))


def alignment(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and over
    its links n_best (how many are best pairs) and the sums of their pairs' links and documents.

    Every row counts, repeated ones too; other columns are ignored; an empty table gives no rows.
    Texts without tokens (see ``index``) have zeros.
    """
    table = index(docs, paths)
    doc_type = docs.schema["doc_id"].dataType
    scores = pair_counts(table)
    scored = (
        table.where("pair IS NOT NULL").select("container", "pair", "weight", "n", "dense", "docs").join(scores, "pair")
        .select("container", F.lit(None).cast(doc_type).alias("doc_id"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(DOCS)],
                "pair", "weight", "n", "dense", "docs", "links", "documents", F.col("is_best").cast("long").alias("is_best"))
    )
    heads = table.where("pair IS NULL").select(
        "container", "doc_id", *T.StructType.fromDDL(DOCS).names, "pair", "weight", "n", "dense", "docs",
        *[F.lit(None).cast("long").alias(c) for c in ("links", "documents", "is_best")],
    )
    # A container's documents come before its postings.
    both = heads.unionByName(scored).repartition("container").sortWithinPartitions("container", F.col("pair").asc_nulls_first())
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def returned(batches):
        of, heads, sums = None, [], None

        def done():
            head = pa.concat_tables(heads).combine_chunks()
            local = head.column("local").to_numpy()
            columns = [head.column("doc_id"), *[head.column(n) for n in names], *[pa.array(sums[k][local]) for k in range(3)]]
            yield from pa.table(columns, names=["doc_id", *names, "n_best", "count_sum", "documents_sum"]).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            container = table.column("container").to_numpy()
            cuts = [0, *(np.flatnonzero(container[1:] != container[:-1]) + 1), len(container)]
            for s, e in zip(cuts, cuts[1:]):
                if container[s] != of:
                    if heads:
                        yield from done()
                    of, heads, sums = container[s], [], np.zeros((3, CONTAINER_DOCS), np.int64)
                part = table.slice(s, e - s)
                n_heads = part.column("pair").null_count
                if n_heads:
                    heads.append(part.slice(0, n_heads))
                part = part.slice(n_heads).combine_chunks()
                if part.num_rows:
                    row, doc = documents_of(part)
                    weight = part.column("weight").to_numpy()
                    for k, name in enumerate(("is_best", "links", "documents")):
                        np.add.at(sums[k], doc, (weight * part.column(name).to_numpy())[row])
        if heads:
            yield from done()

    schema = T.StructType([T.StructField("doc_id", doc_type), *[f for f in T.StructType.fromDDL(DOCS) if f.name in names],
                           *[T.StructField(n, T.LongType()) for n in ("n_best", "count_sum", "documents_sum")]])
    return both.mapInArrow(returned, schema)


def op13(docs: DataFrame) -> DataFrame:
    """Rows without tokens, repeated rows and empty tables: see ``alignment``."""
    return alignment(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "documents_sum")
