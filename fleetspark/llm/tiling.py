"""Benchmark decontamination: greedy string tiling of documents with benchmark items."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspark.llm import textops

#: Shortest match in words; an item of fewer words must be matched as a whole.
MIN_WORDS = 5
#: Share of an item's words that must lie in tiles.
COVERAGE = 0.6
#: Benchmark text sent to the tasks at once; a larger benchmark is compared in several such blocks.
BLOCK_BYTES = 8 << 20
_FIRST_LENGTH = 20
_FILTER_BITS = 20
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = np.full(len(words) + 1, _BASE, np.uint64)
    inverse = np.full(n, _INVERSE, np.uint64)
    powers[0] = inverse[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers[: len(words)], out=sums[1:])
    return textops.mix((sums[size:] - sums[:n]) * np.cumprod(inverse))


def tile(item: np.ndarray, doc: np.ndarray, minimum: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """Tiles (item start, doc start, length) by greedy string tiling with running Karp-Rabin hashes.

    Always the longest match of unmarked words is marked next (of equals the first in the item,
    then in the document).  Search lengths fall from long to ``minimum``; a match over twice the
    length starts again from there.
    """
    m, n = len(item), len(doc)
    used_item, used_doc = np.zeros(m, bool), np.zeros(n, bool)
    tiles: list[tuple[int, int, int]] = []

    def length_at(i: int, j: int) -> int:
        k = min(m - i, n - j)
        bad = (item[i : i + k] != doc[j : j + k]) | used_item[i : i + k] | used_doc[j : j + k]
        return int(bad.argmax()) if bad.any() else k

    def matches(size: int) -> list[tuple[int, int, int]]:
        free_i = _free(used_item, size)
        free_d = _free(used_doc, size)
        own, other = _windows(item, size), _windows(doc, size)
        hit = np.flatnonzero(free_d & np.isin(other, own[free_i]))
        hit = hit[np.argsort(other[hit], kind="stable")]
        keys = other[hit]
        found = []
        for i in np.flatnonzero(free_i):
            at = hit[np.searchsorted(keys, own[i], "left") : np.searchsorted(keys, own[i], "right")]
            if i > 0 and len(at) and not used_item[i - 1]:
                # The same match starts earlier where the words before are equal and free.
                before = np.maximum(at - 1, 0)
                at = at[(at == 0) | (doc[before] != item[i - 1]) | used_doc[before]]
            for j in at:
                k = length_at(i, j)
                if k >= size:
                    found.append((-k, int(i), int(j)))
        return found

    size = max(minimum, min(_FIRST_LENGTH, m))
    while m >= minimum:
        heap = matches(size)
        longest = -min(heap)[0] if heap else 0
        if longest > 2 * size:
            size = longest
            continue
        heapq.heapify(heap)
        while heap:
            k, i, j = heapq.heappop(heap)
            k = -k
            taken = used_item[i : i + k] | used_doc[j : j + k]
            if not taken.any():
                used_item[i : i + k] = True
                used_doc[j : j + k] = True
                tiles.append((i, j, k))
                continue
            # What is left of the match, run by run, waits for its turn.
            edges = np.flatnonzero(np.diff(np.concatenate([[1], taken.astype(np.int8), [1]])))
            for s, e in zip(edges[::2], edges[1::2]):
                if e - s >= size:
                    heapq.heappush(heap, (-int(e - s), int(i + s), int(j + s)))
        if size == minimum:
            break
        size = max(minimum, size // 2)
    return tiles


def _free(used: np.ndarray, size: int) -> np.ndarray:
    """Whether each run of ``size`` places has no used one."""
    if len(used) < size:
        return np.zeros(0, bool)
    sums = np.concatenate([[0], np.cumsum(used)])
    return sums[size:] == sums[: len(used) - size + 1]


class Items:
    """A block of benchmark items as word hashes, with their seeds."""

    def __init__(self, ids: list, texts: list[str]):
        classes = textops.byte_classes(lower=True, punctuation=False)
        self.ids, self.words = [], []
        for first, data, offsets in textops.utf8_slices(pa.array(texts, pa.string())):
            w = textops.Words(data, offsets, classes)
            for r, words in enumerate(np.split(w.hashes(), np.cumsum(w.counts)[:-1])):
                if len(words):
                    self.ids.append(ids[first + r])
                    self.words.append(words)
        by_size: dict[int, list] = {}
        for k, words in enumerate(self.words):
            size = min(MIN_WORDS, len(words))
            by_size.setdefault(size, []).extend((h, k) for h in np.unique(_seeds(words, size)))
        self.seeds = {}
        for size, pairs in by_size.items():
            h = np.array([p[0] for p in pairs], np.uint64)
            order = np.argsort(h, kind="stable")
            table = np.zeros(1 << _FILTER_BITS, bool)
            table[(h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
            self.seeds[size] = (h[order], np.array([p[1] for p in pairs])[order], table)

    def candidates(self, words: np.ndarray, row: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs that share a seed."""
        out: set[tuple[int, int]] = set()
        for size, (seeds, item, table) in self.seeds.items():
            h = _seeds(words, size)
            ok = table[(h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] & (row[: len(h)] == row[size - 1 :])
            for p in np.flatnonzero(ok):
                s, e = np.searchsorted(seeds, h[p], "left"), np.searchsorted(seeds, h[p], "right")
                out.update((int(row[p]), int(k)) for k in item[s:e])
        return out


def _seeds(words: np.ndarray, size: int) -> np.ndarray:
    if len(words) < size:
        return np.zeros(0, np.uint64)
    h = words[: len(words) - size + 1].copy()
    for i in range(1, size):
        h = h * np.uint64(_BASE) + words[i : len(words) - size + 1 + i]
    return textops.mix(h)


def reachable(item: np.ndarray, seeds: np.ndarray, size: int) -> int:
    """Words of an item that tiles with a document can cover at most: those in a run of ``size`` words
    that the document has, too (``seeds``: its runs, sorted)."""
    own = _seeds(item, size)
    at = np.minimum(np.searchsorted(seeds, own), max(0, len(seeds) - 1))
    hit = np.flatnonzero(seeds[at] == own) if len(seeds) else np.zeros(0, np.int64)
    edges = np.zeros(len(item) + 1, np.int64)
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + size, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def _blocks(benchmark: DataFrame):
    ids, texts, held = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull()).toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        held += len(r.text)
        if held >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Contaminated pairs: doc_id, item_id, coverage, n_item_words, tiles (item start, doc start,
    words), one row per document row and item.

    Words are runs of letters and digits, lower-cased.  Null and wordless texts and items match
    nothing; repeated rows and items are each reported.  The benchmark is the stated query set:
    blocks of bounded size are sent to the tasks, and each block is compared with all documents.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id long, coverage double, n_item_words int, tiles array<struct<item_start int, doc_start int, words int>>"
    rows = docs.select("doc_id", "text")
    out = None
    for ids, texts in _blocks(benchmark):
        held = spark.sparkContext.broadcast(Items(ids, texts))
        found = rows.mapInArrow(lambda batches, held=held: _found(batches, held.value, coverage), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _found(batches, items: Items, coverage: float):
    classes = textops.byte_classes(lower=True, punctuation=False)
    piece = pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("words", pa.int32())])
    for batch in batches:
        at, item_ids, shares, sizes, tiles = [], [], [], [], []
        for first, data, offsets in textops.utf8_slices(batch.column("text")):
            w = textops.Words(data, offsets, classes)
            h = w.hashes()
            ends = np.cumsum(w.counts)
            runs: dict[tuple[int, int], np.ndarray] = {}
            for r, k in sorted(items.candidates(h, w.row)):
                item, words = items.words[k], h[ends[r] - w.counts[r] : ends[r]]
                size = min(MIN_WORDS, len(item))
                if (r, size) not in runs:
                    runs = {(r, size): np.sort(_seeds(words, size))}
                # A common phrase alone does not reach the threshold, and is not tiled.
                if reachable(item, runs[r, size], size) < coverage * len(item):
                    continue
                got = tile(item, words, size)
                share = sum(t[2] for t in got) / len(item)
                if share >= coverage:
                    at.append(first + r)
                    item_ids.append(items.ids[k])
                    shares.append(share)
                    sizes.append(len(item))
                    tiles.append([{"item_start": i, "doc_start": j, "words": n} for i, j, n in got])
        ids = batch.column("doc_id").take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(item_ids, pa.int64()), pa.array(shares, pa.float64()), pa.array(sizes, pa.int32()), pa.array(tiles, pa.list_(piece))],
            ["doc_id", "item_id", "coverage", "n_item_words", "tiles"],
        )


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the contaminated ones.  Row for row in one pass, so equal ids do not matter."""
    spark = docs.sparkSession
    for ids, texts in _blocks(benchmark):
        held = spark.sparkContext.broadcast(Items(ids, texts))

        def kept(batches, held=held):
            for batch in batches:
                drop = np.zeros(batch.num_rows, bool)
                numbered = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(batch.schema.get_field_index("text"))], ["doc_id", "text"])
                for found in _found([numbered], held.value, coverage):
                    drop[found.column("doc_id").to_numpy(zero_copy_only=False)] = True
                yield batch.filter(pa.array(~drop))

        docs = docs.mapInArrow(kept, T.StructType([*docs.schema.fields]))
    return docs


def op5(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = leaks(docs, benchmark)
    return found.select(
        "doc_id", "item_id", "coverage", F.size("tiles").alias("n_tiles"), F.aggregate("tiles", F.lit(0), lambda a, t: a + t["words"]).alias("n_words"), "n_item_words",
    )
