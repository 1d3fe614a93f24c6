"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm import textops
from fleetspark.llm.tables import fold_of, labelled_sample, written

#: Bounds of the labelled examples in the index: their number, and their (example, term) pairs.
EXAMPLE_ROWS = 8192
EXAMPLE_TERMS = 16_000_000
FOLDS = 5
NEIGHBOURS = 16
#: Examples in a block.
BLOCK = 1024
#: Terms that very many examples have lie in a dense table; texts are multiplied with it so many at a time.
FREQUENT, TOGETHER = 1024, 256
#: More than single precision loses in a cosine; what is that close to a limit is added up exactly.
MARGIN = 1e-5
#: Answers remembered per task.
ASKED = 20_000
#: Weight of the base rate in a vote.
PRIOR = 0.5
#: A term's chance of looking this telling by accident, over all terms, and the weight of a term that tells nothing.
ERROR, LEAST_WEIGHT = 0.05, 0.05
_PREFIX_BYTES = 5


def terms(column: pa.Array):
    """Yields (first row, term hash, row, rows): each lower-cased word and, of longer words, its beginning."""
    classes = textops.byte_classes(lower=True, punctuation=False)
    for first, data, offsets in textops.utf8_slices(column):
        w = textops.Words(data, offsets, classes)
        long = w.end - w.start > _PREFIX_BYTES
        begins = w.hashes(np.minimum(w.end, w.start + _PREFIX_BYTES)) ^ np.uint64(0x5BF03635)
        yield first, np.concatenate([w.hashes(), begins[long]]), np.concatenate([w.row, w.row[long]]), w.rows


def evidence(term: np.ndarray, row: np.ndarray, labels: np.ndarray, n_terms: int) -> np.ndarray:
    """Weight of every term from its chi-square against the label: 1 where it could hardly be chance over
    all terms, less below that by the square of what it lacks, ``LEAST_WEIGHT`` at least."""
    n, toxic = len(labels), labels.sum()
    if not 0 < toxic < n:
        return np.ones(n_terms)
    with_toxic = np.bincount(term, labels[row], n_terms)
    with_any = np.bincount(term, minlength=n_terms).astype(float)
    expected = with_any * toxic / n
    variance = expected * (1 - toxic / n) * (1 - with_any / n) * n / max(1, n - 1)
    chi = np.where(variance > 0, (with_toxic - expected) ** 2 / np.maximum(variance, 1e-12), 0)
    return np.clip((chi / (2 * np.log(max(2, n_terms) / ERROR))) ** 2, LEAST_WEIGHT, 1)


def features(batches):
    """(doc_id, label, terms, tf) of examples: distinct terms and how often the text has them."""
    for batch in batches:
        n = batch.num_rows
        out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * n
        for first, h, row, count in terms(batch.column("text")):
            order = np.argsort(row, kind="stable")
            for r, found in enumerate(np.split(h[order], np.cumsum(np.bincount(row, minlength=count))[:-1])):
                out[first + r] = np.unique(found, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array([t.view(np.int64) for t, _ in out], pa.list_(pa.int64())),
             pa.array([f.astype(np.int32) for _, f in out], pa.list_(pa.int32()))], ["doc_id", "label", "terms", "tf"],
        )


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers start, start + 1, ... of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _runs(numbers: np.ndarray):
    """(first, last + 1) of each run of consecutive numbers, which ascend."""
    if len(numbers) and numbers[-1] - numbers[0] == len(numbers) - 1:
        return [(int(numbers[0]), int(numbers[-1]) + 1)]
    cuts = np.flatnonzero(np.diff(numbers) != 1) + 1
    return [(int(x[0]), int(x[-1]) + 1) for x in np.split(numbers, cuts) if len(x)]


class Vocabulary:
    """Terms by hash, in order, found through a table by the hash's lower bits: place, none, or several."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.mask = np.uint64((1 << max(10, int(len(hashes)).bit_length() + 3)) - 1)
        slot = (hashes & self.mask).astype(np.int64)
        self.table = np.full(int(self.mask) + 1, -1, np.int32)
        self.table[slot] = np.arange(len(hashes))
        self.table[slot[self.table[slot] != np.arange(len(hashes))]] = -2

    def __getstate__(self):
        return self.hashes

    def __setstate__(self, hashes):
        self.__init__(hashes)

    def rows(self, column: pa.Array):
        """(terms, frequencies) of each text over the vocabulary."""
        out = [None] * len(column)
        for first, h, row, count in terms(column):
            at = self.table[(h & self.mask).astype(np.int64)]
            several = np.flatnonzero(at == -2)
            if len(several):
                at[several] = np.minimum(np.searchsorted(self.hashes, h[several]), len(self.hashes) - 1)
            hit = np.flatnonzero(at >= 0)
            at, row = at[hit], row[hit]
            ok = self.hashes[at] == h[hit]
            # Sorted by text and term at once; runs of equal ones are the frequencies.
            size = max(1, len(self.hashes))
            pairs = np.sort(row[ok].astype(np.int64) * size + at[ok])
            starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
            found, counts = pairs[starts], np.diff(np.append(starts, len(pairs)))
            cuts = np.searchsorted(found, np.arange(count + 1) * size)
            found %= size
            for r, (s, e) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
                out[first + r] = found[s:e], counts[s:e]
        return out


class Index:
    """Unit vectors of examples by term.

    Terms that very many examples have lie in a dense table.  The others have postings, and for each
    block of ``BLOCK`` consecutive examples their largest weight: what a block's examples reach at most
    is known without their postings.
    """

    def __init__(self, ids, labels, term: np.ndarray, tf: np.ndarray, sizes: np.ndarray, vocabulary: np.ndarray, idf, weight_of):
        self.vocabulary, self.idf, self.weight_of = Vocabulary(vocabulary), idf, weight_of
        self.base = float(labels.mean()) if len(labels) else 0.0
        none = sizes == 0
        self.empty = float(labels[none].sum() / (none.sum() + 1)) if none.any() else self.base
        self.ids, self.labels = ids, labels.astype(float)
        self.slope, self.shift = 1.0, 0.0
        row = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        order = np.argsort(term, kind="stable")  # rows stay in order
        small_ = lambda x: x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)
        self.spread = np.bincount(term, minlength=len(vocabulary)).astype(np.int32)
        self.row, self.tf = small_(row[order]), small_(tf[order].astype(np.int64))
        self.built = False

    def __getstate__(self):
        # Tasks are sent the terms' rows and frequencies and make the rest of them.
        names = ("vocabulary", "idf", "weight_of", "base", "empty", "ids", "labels", "slope", "shift", "spread", "row", "tf")
        return {name: getattr(self, name) for name in names}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.built = False

    def _build(self) -> None:
        n_terms, n = len(self.spread), len(self.ids)
        self._asked: dict[bytes, list[tuple[float, int]]] = {}
        term, row = np.repeat(np.arange(n_terms, dtype=np.int32), self.spread), self.row.astype(np.int32)
        weight = (1 + np.log(self.tf.astype(float))) * (self.idf * self.weight_of)[term]
        weight /= np.sqrt(np.bincount(row, weight * weight, n))[row]
        # The examples themselves, for exact sums.
        order = np.argsort(row, kind="stable")
        self.of_term, self.of_weight = term[order], weight[order]
        self.of_ends = np.append(0, np.cumsum(np.bincount(row, minlength=n)))
        self.query = np.zeros(n_terms)
        self.n_blocks = -(-n // BLOCK)
        often = np.sort(np.argsort(-self.spread, kind="stable")[:FREQUENT])
        self.dense_at = np.full(n_terms, -1, np.int32)
        self.dense_at[often] = np.arange(len(often))
        at = self.dense_at[term]
        self.dense = np.zeros((len(often), self.n_blocks * BLOCK), np.float32)
        self.dense[at[at >= 0], row[at >= 0]] = weight[at >= 0]
        # Postings of the other terms, and the largest weight of each in each block.
        term, place, weight = term[at < 0], row[at < 0], weight[at < 0].astype(np.float32)
        # A posting is one number: the example above, its weight below.
        self.posting = place.astype("<i8") << 32 | weight.view("<u4")
        self.ends = np.searchsorted(term, np.arange(n_terms + 1))
        block = place // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        starts = np.flatnonzero(new)
        self.most = np.zeros((n_terms, self.n_blocks), np.float32)
        if len(term):
            self.most[term[starts], block[starts]] = np.maximum.reduceat(weight, starts)
        self.built = True

    def weights(self, t, tf):
        w = (1 + np.log(tf)) * self.idf[t] * self.weight_of[t]
        return w / np.sqrt((w * w).sum())

    def nearest(self, questions: list[tuple[np.ndarray, np.ndarray]], own_ids: list, k: int = NEIGHBOURS) -> list[list[tuple[float, int]]]:
        """Per text (terms, frequencies) the exact ``k`` nearest (cosine, example) with a cosine over 0; of
        equals the first example.  A text's own example is not among them."""
        if not self.built:
            self._build()
        # Copies ask the same question again and again; one neighbour more allows for the text itself.
        keys = [hashlib.blake2b(t.tobytes() + np.asarray(f, float).tobytes() + bytes([k]), digest_size=16).digest() if len(t) else None for t, f in questions]
        todo = list({key: i for i, key in enumerate(keys) if key is not None and key not in self._asked}.values())
        if len(self._asked) + len(todo) > ASKED:
            self._asked.clear()
            todo = list({key: i for i, key in enumerate(keys) if key is not None}.values())
        for s in range(0, len(todo), TOGETHER):
            some = todo[s : s + TOGETHER]
            for i, best in zip(some, self._nearest([questions[i] for i in some], k + 1)):
                self._asked[keys[i]] = best
        found = [self._asked[key] if key is not None else [] for key in keys]
        return [[x for x in best if own is None or self.ids[x[1]] != own][:k] for best, own in zip(found, own_ids)]

    def _nearest(self, questions, k: int):
        weights = [self.weights(t, f) for t, f in questions]
        asked = np.zeros((len(questions), len(self.dense)), np.float32)
        for i, ((t, _), q) in enumerate(zip(questions, weights)):
            at = self.dense_at[t]
            asked[i, at[at >= 0]] = q[at >= 0]
        frequent = asked @ self.dense
        for (t, _), q, sums in zip(questions, weights, frequent):
            rare = self.dense_at[t] < 0
            t_rare, q_rare = t[rare], q[rare]
            n = len(self.ids)
            # Frequent terms alone bring k examples this near; a block whose best cannot be is left out.
            least = np.partition(sums[:n], n - k)[n - k] if n >= k else 0.0
            bound = sums.reshape(self.n_blocks, BLOCK).max(axis=1) + q_rare @ self.most[t_rare]
            blocks = np.flatnonzero(bound >= least - 2 * MARGIN)
            starts, ends = self.ends[t_rare], self.ends[t_rare + 1]
            scores = sums.astype(float)  # of examples in blocks left out, less than their score
            for first, last in _runs(blocks):
                if first > 0 or last < self.n_blocks:
                    starts_, ends_ = self._within(starts, ends, first * BLOCK, last * BLOCK)
                else:
                    starts_, ends_ = starts, ends
                if len(starts_):
                    sizes = ends_ - starts_
                    found = self.posting.take(_ranges(starts_, sizes))  # hundreds of short lists, faster than one by one
                    weight = found.view(np.float32)[::2] * np.repeat(q_rare, sizes)
                    scores += np.bincount(found >> 32, weight, len(scores))
            known = scores[:n]
            least = np.partition(known, n - k)[n - k] if n >= k else 0.0
            yield self._exact(t, q, np.flatnonzero(known >= max(least - 2 * MARGIN, 0.0)) if least > MARGIN else np.flatnonzero(known > -MARGIN))[:k]

    def _within(self, starts, ends, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """The parts of posting lists that lie in a range of examples."""
        pairs = [(s + np.searchsorted(self.posting[s:e], low << 32), s + np.searchsorted(self.posting[s:e], high << 32)) for s, e in zip(starts.tolist(), ends.tolist())]
        found = np.array(pairs, np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    def _exact(self, t, q, near) -> list[tuple[float, int]]:
        """(cosine, example) of the examples, best first, without those of cosine 0."""
        self.query[t] = q
        spans = zip(self.of_ends[near].tolist(), self.of_ends[near + 1].tolist())
        scores = np.round([self.query.take(self.of_term[s:e]) @ self.of_weight[s:e] for s, e in spans], 9)
        self.query[t] = 0
        order = np.lexsort((near, -scores))
        return [(float(scores[j]), int(near[j])) for j in order if scores[j] > 0]

    def vote(self, near: list[tuple[float, int]]) -> float:
        total = sum(s for s, _ in near)
        return (sum(s * self.labels[p] for s, p in near) + PRIOR * self.base) / (total + PRIOR)

    def calibrated(self, vote: float) -> float:
        v = min(max(vote, 1e-6), 1 - 1e-6)
        return float(1 / (1 + np.exp(-np.clip(self.slope * np.log(v / (1 - v)) + self.shift, -35, 35))))

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Logistic fit of the labels on the votes of each example's neighbours without itself."""
        v = np.clip(votes, 1e-6, 1 - 1e-6)
        x = np.stack([np.log(v / (1 - v)), np.ones(len(v))], axis=1)
        w = np.array([1.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
            gradient = x.T @ (p - labels) + (w - [1.0, 0.0])
            w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), gradient)
        if w[0] > 0:
            self.slope, self.shift = float(w[0]), float(w[1])


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of a column of lists."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.value_lengths().fill_null(0), np.int64)


def fit(docs: DataFrame, labels: DataFrame, example_rows: int = EXAMPLE_ROWS, example_terms: int = EXAMPLE_TERMS) -> Index:
    """The index of labelled documents outside fold 0, all terms of them: by a hash of the id the first
    ``example_rows``, as far as they have ``example_terms`` distinct terms together.  Document frequencies
    are counted over all documents."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, "toxic", FOLDS, 0, example_rows)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = written(sample.mapInArrow(features, f"doc_id {id_type}, label int, terms array<long>, tf array<int>"), spark, "examples")
    if (found.agg(F.sum(F.size("terms"))).first()[0] or 0) > example_terms:
        # One number per example, so the running sum is over a bounded number of rows.
        upto = F.sum(F.size("terms")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
        few = found.select("doc_id", upto.alias("upto")).where(F.col("upto") <= example_terms).select("doc_id")
        found = found.join(F.broadcast(few), "doc_id")
    examples, found = found, found.toArrow().sort_by("doc_id")
    raw, sizes = _flat(found["terms"])
    tf = _flat(found["tf"])[0]
    vocabulary, term = np.unique(raw.astype(np.int64, copy=False).view(np.uint64), return_inverse=True)
    label, term = found["label"].to_numpy().astype(float), term.astype(np.int32)
    ids = np.array(found["doc_id"].to_pylist(), dtype=None if pa.types.is_integer(found["doc_id"].type) else object)
    del raw, found
    counting = spark.sparkContext.broadcast(Vocabulary(vocabulary))

    def counted(batches):
        words = counting.value
        seen, n = np.zeros(len(words.hashes), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for t, _ in words.rows(batch.column("text")):
                seen[t] += 1
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(seen[used], n), pa.int64())], ["term", "n"])

    # As many rows as the examples have terms.
    counts = docs.select("text").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counting.destroy()
    at, seen = counts["term"].to_numpy(), counts["n"].to_numpy()
    df = np.zeros(len(vocabulary))
    df[at[at >= 0]] = seen[at >= 0]
    n = int(seen[at < 0].sum())
    tells = evidence(term, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), label, len(vocabulary))
    index = Index(ids, label, term, tf, sizes, vocabulary, np.log((1 + n) / (1 + df)) + 1, tells)
    # Sent once, for the votes and for whoever scores; slope and shift come after and go with the work.
    index.sent = spark.sparkContext.broadcast(index)
    if len(ids):
        index.calibrate(*_votes(examples, index))
    return index


def _votes(examples: DataFrame, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Votes for the examples by the others, and their labels; a task has a part of the examples."""
    held = index.sent

    def voted(batches):
        index = held.value
        for batch in batches:
            questions = []
            for t, f in zip(batch.column("terms"), batch.column("tf")):
                at = np.searchsorted(index.vocabulary.hashes, t.values.to_numpy().view(np.uint64))
                questions.append((at, f.values.to_numpy().astype(float)))
            near = index.nearest(questions, batch.column("doc_id").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([index.vote(x) if x else None for x in near], pa.float64())], ["label", "vote"])

    found = examples.mapInArrow(voted, "label int, vote double").where("vote IS NOT NULL").orderBy("label", "vote").toArrow()
    return found["vote"].to_numpy(), found["label"].to_numpy().astype(float)


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score, and the evidence: ids and cosines of the nearest examples.

    An example is no evidence for itself.  A text without any term of the examples (so also a null or
    empty one) gets the toxic share of such examples, or of all if there are none; without examples
    every score is 0.  Repeated rows are scored alike.
    """
    held, slope, shift = index.sent, index.slope, index.shift
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches):
        index = held.value
        index.slope, index.shift = slope, shift
        for batch in batches:
            near = index.nearest(index.vocabulary.rows(batch.column("text")), batch.column("doc_id").to_pylist()) if len(index.ids) else [[]] * batch.num_rows
            p = [index.calibrated(index.vote(x)) if x else index.empty for x in near]
            near_ids, near_cos = [[index.ids[i] for _, i in x] for x in near], [[s for s, _ in x] for x in near]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p, pa.float64()), pa.array(near_ids, pa.list_(batch.column("doc_id").type)), pa.array(near_cos, pa.list_(pa.float64()))],
                ["doc_id", "score", "neighbours", "cosines"],
            )

    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {id_type}, score double, neighbours array<{id_type}>, cosines array<double>")


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, fit(docs, labels))
    return out.select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"),
    )
