"""Near-duplicate documents: Jaccard join of word 5-gram sets by chosen paths.

Sets are embedded as 64 MinHash tokens.  From the root on, every set follows those of its tokens
that a hash of path and token selects, 1/threshold of them on average, so that similar sets keep
meeting and others part.  Buckets of up to ``LIMIT`` sets are compared pair by pair.  Of larger
ones every set is compared with ``SAMPLES`` members, which links groups of copies that no path
would split.  Sets outside the bucket's largest component are then compared with the whole bucket, if
they are at most ``OUTLIERS``: with that all of its pairs are settled.  Only buckets with more of them go
on to the next level.  ``REPETITIONS`` independent trees reach the target recall.  Comparing tokens loosely
gives candidate components, and exact Jaccard is then computed for all pairs of each component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspark.llm import textops
from fleetspark.llm.components import components
from fleetspark.llm.tables import row_key, written

WORDS = 5
TOKENS = 64
#: Similarity, as a fraction, from which two sets are linked.
NUMERATOR, DENOMINATOR = 4, 5
#: A pair at the threshold survives four levels of one tree with probability 0.31; ten trees give 0.976.
REPETITIONS = 10
LEVELS = 4
LIMIT = 32
#: Members of a larger bucket that all others are compared with.
SAMPLES = 8
#: Sets outside the largest component of a larger bucket, up to which they are compared with all others.
OUTLIERS = 8192
#: Sets compared in one group.
CHUNK = 1024
#: Equal tokens from which a pair of a bucket is a candidate: four standard deviations below the threshold.
LOOSE = 38
#: Text bytes hashed at once: a task's arrays for them take some sixty times as much.
SLICE_BYTES = 1 << 18
#: Shingles compared in one group; larger components, also those of over ``CHUNK`` sets, are dealt to pairs of chunks.
GROUP_SHINGLES = 300_000


def _unique(h: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return [np.unique(x) for x in np.split(h, np.cumsum(counts)[:-1])]


def sets_of(column: pa.Array):
    """Yields (first row, sorted distinct shingle hashes of each row)."""
    classes = textops.byte_classes(lower=True, punctuation=False)
    for first, data, offsets in textops.utf8_slices(column, SLICE_BYTES):
        w = textops.Words(data, offsets, classes)
        h, row = textops.shingles(w.hashes(), w.row, w.counts, WORDS)
        yield first, _unique(h, np.bincount(row, minlength=w.rows))


def key_of(h: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return np.array([textops.mix(h).sum(dtype=np.uint64), textops.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)]).tobytes()


def _multipliers() -> np.ndarray:
    return textops.mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketch(h: np.ndarray) -> np.ndarray:
    """MinHash tokens of a set that isn't empty."""
    return np.array([(h * a).min() >> np.uint64(32) for a in _multipliers()], np.uint64).astype(np.uint32)


def _keyed(batches):
    for batch in batches:
        n = batch.num_rows
        keys, sizes, sketches = [None] * n, [0] * n, [None] * n
        for first, sets in sets_of(batch.column("text")):
            for r, h in enumerate(sets):
                if len(h):
                    keys[first + r], sizes[first + r], sketches[first + r] = key_of(h), len(h), sketch(h).tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())],
            ["doc_id", "row_key", "set_key", "n", "sketch"],
        )


def _chosen(paths: np.ndarray, sketches: np.ndarray):
    """(row, next path) of the tokens that each row's path selects."""
    token = textops.mix(sketches.astype(np.uint64) << np.uint64(8) | np.arange(TOKENS, dtype=np.uint64))
    h = textops.mix(token ^ textops.mix(paths)[:, None])
    row, at = np.nonzero(h < np.uint64(DENOMINATOR * (1 << 64) // (NUMERATOR * TOKENS)))
    return row, textops.mix(h[row, at] ^ np.uint64(0x632BE59BD9B4E019))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), TOKENS)


def _roots(batches):
    for batch in batches:
        sketches = _matrix(batch.column("sketch"))
        for s in range(0, len(sketches), 4096):
            part = sketches[s : s + 4096]
            for r in range(REPETITIONS):
                row, path = _chosen(np.full(len(part), r + 1, np.uint64), part)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column("set_key").take(pa.array(row + s))], ["path", "set_key"])


def _deeper(batches):
    for batch in batches:
        sketches, paths = _matrix(batch.column("sketch")), batch.column("path").to_numpy().view(np.uint64)
        for s in range(0, len(sketches), 4096):
            row, path = _chosen(paths[s : s + 4096], sketches[s : s + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column("set_key").take(pa.array(row + s))], ["path", "set_key"])


def _groups(batches, names: list[str]):
    """Tables of whole groups from batches sorted by the key columns."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        last = [held.column(n)[held.num_rows - 1].as_py() for n in names]
        end = held.num_rows
        # The last group may go on in the next batch.
        while end and all(held.column(n)[end - 1].as_py() == v for n, v in zip(names, last)):
            end -= 1
        if end:
            yield held.slice(0, end).combine_chunks()
            held = held.slice(end).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component under the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            break
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
    return label


def _loose(batches):
    """Star edges between sets of a bucket whose tokens agree loosely."""
    keys = ["path", "c1", "c2"]
    for table in _groups(batches, keys):
        sketches = _matrix(table.column("sketch").combine_chunks())
        ids = [table.column(k).to_numpy() for k in keys]
        n = len(sketches)
        new = np.ones(n, bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in ids], axis=0)
        group = np.cumsum(new) - 1
        longest = int(np.bincount(group).max())
        a, b = [], []
        for d in range(1, min(longest, n)):
            at = np.flatnonzero(group[:-d] == group[d:])
            if not len(at):
                break
            for s in range(0, len(at), 65536):
                p = at[s : s + 65536]
                ok = (sketches[p] == sketches[p + d]).sum(axis=1) >= LOOSE
                a.append(p[ok])
                b.append(p[ok] + d)
            if sum(map(len, a)) > 1 << 20:  # what is linked already need not be kept pair by pair
                x, y = np.concatenate(a), np.concatenate(b)
                label = _least_labels(n, x, y)
                own = np.flatnonzero(label != np.arange(n))
                a, b = [label[own]], [own]
        a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (a, b))
        label = _least_labels(n, a, b)
        own = np.flatnonzero(label != np.arange(n))
        column = table.column("set_key").combine_chunks()
        yield pa.RecordBatch.from_arrays([column.take(pa.array(own)), column.take(pa.array(label[own]))], ["a", "b"])


def _with_samples(batches):
    """Star edges (a, b) between the sets of a bucket's chunk and the samples that come with them, and the
    ``path`` of the bucket if they don't link all of these sets to each other."""
    for table in _groups(batches, ["path", "chunk"]):
        path, chunk = (table.column(k).to_numpy() for k in ("path", "chunk"))
        sketches, sample = _matrix(table.column("sketch").combine_chunks()), table.column("sample").to_numpy()
        starts = np.append(0, 1 + np.flatnonzero((path[1:] != path[:-1]) | (chunk[1:] != chunk[:-1])))
        a, b = [], []
        for s, e in zip(starts, np.append(starts[1:], table.num_rows)):
            for p in s + np.flatnonzero(sample[s:e]):
                like = s + np.flatnonzero((sketches[s:e] == sketches[p]).sum(axis=1) >= LOOSE)
                a.append(np.full(len(like), p))
                b.append(like)
        a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (a, b))
        label = _least_labels(table.num_rows, a, b)
        own = np.flatnonzero(label != np.arange(table.num_rows))
        column = table.column("set_key").combine_chunks()
        parts = np.add.reduceat(label == np.arange(table.num_rows), starts)
        unsettled = np.unique(path[starts[parts > 1]])
        none = pa.nulls(len(unsettled), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([x, none]) for x in (column.take(pa.array(own)), column.take(pa.array(label[own])))]
            + [pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array(unsettled, pa.int64())])], ["a", "b", "path"],
        )


def _with_outliers(batches):
    """Star edges between the sets of a bucket's chunk and the outliers of the bucket that come with them."""
    ones = np.uint64(0x0101010101010101)
    for table in _groups(batches, ["path", "chunk"]):
        path, chunk = (table.column(k).to_numpy() for k in ("path", "chunk"))
        sketches, sample = _matrix(table.column("sketch").combine_chunks()), table.column("sample").to_numpy()
        low = sketches.astype(np.uint8)
        starts = np.append(0, 1 + np.flatnonzero((path[1:] != path[:-1]) | (chunk[1:] != chunk[:-1])))
        a, b, held = [], [], 0
        for s, e in zip(starts, np.append(starts[1:], table.num_rows)):
            members = s + np.flatnonzero(~sample[s:e])
            near = low[members]
            for p in s + np.flatnonzero(sample[s:e]):
                # The tokens' lowest bytes agree at least as often as the tokens; eight counts to a number.
                agree = (near == low[p]).view(np.uint64).sum(axis=1) * ones >> np.uint64(56)
                like = members[agree >= LOOSE]
                like = like[(sketches[like] == sketches[p]).sum(axis=1) >= LOOSE]
                a.append(np.full(len(like), p))
                b.append(like)
                held += len(like)
                if held > 1 << 20:  # what is linked already need not be kept pair by pair
                    label = _least_labels(table.num_rows, np.concatenate(a), np.concatenate(b))
                    own = np.flatnonzero(label != np.arange(table.num_rows))
                    a, b, held = [label[own]], [own], 0
        a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (a, b))
        label = _least_labels(table.num_rows, a, b)
        own = np.flatnonzero(label != np.arange(table.num_rows))
        column = table.column("set_key").combine_chunks()
        yield pa.RecordBatch.from_arrays([column.take(pa.array(own)), column.take(pa.array(label[own]))], ["a", "b"])


def _exact(batches):
    """Per set of a group its exact links, and star edges of the components they form.  A group of
    two chunks counts the pairs between them only; the pairs within belong to each chunk's own group."""
    keys = ["root", "c1", "c2"]
    for table in _groups(batches, keys):
        names = [table.column(k) for k in keys]
        order = [tuple(c[i].as_py() for c in names) for i in range(table.num_rows)]
        cuts = [0, *[i for i in range(1, len(order)) if order[i] != order[i - 1]], len(order)]
        for s, e in zip(cuts, cuts[1:]):
            part = table.slice(s, e - s)
            c1, c2 = order[s][1:]
            chunk = part.column("chunk").to_numpy()
            sets = [h for _, found in sets_of(part.column("text").combine_chunks()) for h in found]
            n = len(sets)
            links, label = _links(sets, chunk, c1 != c2)
            column = part.column("set_key").combine_chunks()
            yield pa.RecordBatch.from_arrays([column, column.take(pa.array(label)), pa.array(links, pa.int64())], ["a", "b", "links"])


def _links(sets: list[np.ndarray], chunk: np.ndarray, between: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(sets)
    sizes = np.array([len(h) for h in sets])
    every = np.concatenate(sets)
    row = np.repeat(np.arange(n), sizes)
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    column = np.cumsum(new) - 1
    common = np.bincount(column) > 1
    keep = common[column]
    column, row = (np.cumsum(common) - 1)[column[keep]], row[keep]
    width = int(common.sum())
    # Intersections by products of incidence matrices, some thousand shingles at a time; of two chunks
    # only one's rows by the other's.
    first = chunk == chunk.min() if between else np.ones(n, bool)
    left, right = np.flatnonzero(first), np.flatnonzero(~first if between else first)
    shared = np.zeros((len(left), len(right)), np.float32)
    step = max(256, min(8192, (1 << 20) // max(1, n)))
    cuts = np.searchsorted(column, np.arange(0, width + step, step))
    for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
        if e > s:
            x = np.zeros((n, step), np.float32)
            x[row[s:e], column[s:e] - k * step] = 1
            shared += x[left] @ x[right].T if between else x @ x.T
    sizes = sizes.astype(np.float32)
    shared *= NUMERATOR + DENOMINATOR
    linked = shared >= NUMERATOR * (sizes[left][:, None] + sizes[right][None, :])
    if not between:
        np.fill_diagonal(linked, False)
    links = np.zeros(n, np.int64)
    links[left] = linked.sum(axis=1)
    if between:
        links[right] = linked.sum(axis=0)
    a, b = np.nonzero(linked if between else np.triu(linked))
    return links, _least_labels(n, left[a], right[b])


def _dealt(rows: DataFrame, key: str, chunks: str, by: str) -> DataFrame:
    """Deal each group's rows to ``chunks`` chunks, and each row to the pairs of its chunk with all."""
    return (
        rows.withColumn("chunk", F.pmod(F.xxhash64(by), F.col(chunks)).cast("int"))
        .withColumn("other", F.explode(F.expr(f"sequence(0, cast({chunks} AS INT) - 1)")))
        .withColumn("c1", F.least("chunk", "other")).withColumn("c2", F.greatest("chunk", "other")).drop("other", chunks)
    )


def _in_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, row_key, class_id, n_links, n_copies, keeper.

    Two documents are linked if the Jaccard similarity of their sets of word 5-grams is at least
    4/5 (words: runs of letters and digits, lower-cased; a shorter text is one gram).  ``class_id``
    is the smallest doc_id of the component (null only if it has none), ``n_links`` the number of other sets at
    that similarity, ``n_copies`` the number of rows with the very same set.  ``keeper`` is the
    row_key of the class's first row by (doc_id, row_key), nulls last.  Null and wordless texts are
    classes of their own.
    """
    rows = written(
        docs.select("doc_id", "text", row_key(docs).alias("row_key")).mapInArrow(
            _keyed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key binary, set_key binary, n int, sketch binary"
        ), spark, "sketches",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    sets = written(
        rows.where("set_key IS NOT NULL").groupBy("set_key")
        .agg(first.alias("first"), F.count("*").alias("n_copies"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")), spark, "sets",
    )
    roots = components(_candidates(spark, sets)).select(F.col("node").alias("set_key"), "root")
    members = written(sets.select("set_key", "n").join(roots, "set_key"), spark, "members")
    totals = members.groupBy("root").agg(F.ceil(F.greatest(F.sum("n") / GROUP_SHINGLES, F.count("*") / CHUNK)).alias("chunks"))
    # One text per set goes on; copies are left behind by the row that comes first.
    chosen = members.join(totals, "root").join(sets.select("set_key", F.col("first.row_key").alias("row_key")), "set_key").select("set_key", "root", "chunks", "row_key")
    texts = docs.select("text", row_key(docs).alias("row_key")).join(chosen, "row_key").dropDuplicates(["row_key"])
    verified = written(
        _in_groups(_dealt(texts.select("set_key", "text", "root", "chunks"), "root", "chunks", "set_key"), ["root", "c1", "c2"])
        .select("root", "c1", "c2", "chunk", "set_key", "text").mapInArrow(_exact, "a binary, b binary, links long"), spark, "links",
    )
    links = verified.groupBy(F.col("a").alias("set_key")).agg(F.sum("links").alias("n_links"))
    strict = components(verified.select("a", "b")).select(F.col("node").alias("set_key"), "root")
    named = sets.select("set_key", "first", "n_copies").join(links, "set_key", "left").join(strict, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    named = named.join(heads, "root").select(
        "set_key", F.col("head.doc_id").alias("class_id"), F.col("head.row_key").alias("keeper"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"
    )
    return rows.select("doc_id", "row_key", "set_key").join(named, "set_key", "left").select(
        "doc_id", "row_key", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("keeper", "row_key").alias("keeper"),
    )


def _candidates(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """Star edges (a, b) of loosely similar sets from all trees."""
    sketches = sets.select("set_key", "sketch")
    level = sketches.mapInArrow(_roots, "path long, set_key binary")
    found = None
    for depth in range(1, LEVELS + 1):
        sizes = level.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        met = written(level.join(sizes, "path").join(sketches, "set_key"), spark, "level")
        last = depth == LEVELS
        here = met if last else met.where(F.col("size") <= LIMIT)
        # Buckets of the last level are as large as their copies are many: they are dealt to pairs of chunks.
        dealt = _dealt(here.withColumn("chunks", F.ceil(F.col("size") / CHUNK)), "path", "chunks", "set_key")
        edges = _in_groups(dealt, ["path", "c1", "c2"]).select("path", "c1", "c2", "set_key", "sketch").mapInArrow(_loose, "a binary, b binary")
        large = None if last else met.where(F.col("size") > LIMIT)
        if large is not None and large.isEmpty():
            large = None
        if large is not None:
            sampled = written(_in_chunks(large, _first(large)).mapInArrow(_with_samples, "a binary, b binary, path long"), spark, "sampled")
            edges = edges.unionByName(sampled.where("path IS NULL").select("a", "b"))
        edges = written(edges.distinct(), spark, "stars")
        found = edges if found is None else found.unionByName(edges)
        if large is None:
            break
        roots = components(found)
        unsettled = _unsettled(large, sampled.where("path IS NOT NULL").select("path").distinct(), roots)
        large = written(large.join(unsettled, "path", "left_semi"), spark, "unsettled")
        outside = written(_outside(large, roots), spark, "outside")
        few = outside.where(F.col("n") <= OUTLIERS).select("path", "set_key")
        settled = large.join(few.select("path").distinct(), "path", "left_semi")
        checked = _in_chunks(settled, settled.join(few, ["path", "set_key"], "left_semi")).mapInArrow(_with_outliers, "a binary, b binary")
        # Stars of the components say what their edges said.
        found = written(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(checked), spark, "stars")
        many = outside.where(F.col("n") > OUTLIERS).select("path").distinct()
        if many.isEmpty():
            break
        level = large.join(many, "path", "left_semi").select("path", "set_key", "sketch").mapInArrow(_deeper, "path long, set_key binary")
    return found


def _unsettled(large: DataFrame, paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Of the buckets ``paths`` those whose sets are in several components (node, root) of all edges found so
    far, in any tree: sets of one candidate component stay one whatever follows."""
    rooted = large.select("path", "set_key").join(roots, F.col("set_key") == F.col("node"), "left")
    ends = rooted.groupBy("path").agg(*[f(F.coalesce("root", "set_key")).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    return ends.where("lo < hi").select("path").join(paths, "path", "left_semi")


def _first(large: DataFrame) -> DataFrame:
    """``SAMPLES`` members of each bucket."""
    order = Window.partitionBy("path").orderBy(F.xxhash64("set_key", "path"), "set_key")
    return large.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLES).drop("nth")


def _outside(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, set_key, n) of the sets outside the component that most of their bucket are in, and their number in
    the bucket.  Components (node, root) are those of all edges found so far, in any tree: sets of one
    candidate component stay one whatever follows."""
    rooted = large.select("path", "set_key", "size").join(roots, F.col("set_key") == F.col("node"), "left").select("path", "set_key", "size", F.coalesce("root", "set_key").alias("root"))
    most = rooted.groupBy("path", "root").agg(F.count("*").alias("here"))
    most = most.groupBy("path").agg(F.max(F.struct("here", "root")).alias("most")).select("path", "most.*").withColumnRenamed("root", "main")
    return rooted.join(most, "path").where("root <> main").select("path", "set_key", (F.col("size") - F.col("here")).alias("n"))


def _in_chunks(large: DataFrame, some: DataFrame) -> DataFrame:
    """Chunks of the sets of each bucket, each with ``some`` of the bucket (``sample``)."""
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    rows = large.select("path", F.pmod(F.xxhash64("set_key"), chunks).cast("int").alias("chunk"), "set_key", "sketch", F.lit(False).alias("sample"))
    some = some.select("path", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "set_key", "sketch", F.lit(True).alias("sample"))
    return _in_groups(rows.unionByName(some), ["path", "chunk"]).select("path", "chunk", "set_key", "sketch", "sample")


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, the first by doc_id; wordless documents stay."""
    keepers = classes(spark, docs).select(F.col("keeper").alias("__keeper")).distinct()
    keyed = docs.withColumn("__row", row_key(docs))
    kept = keyed.join(keepers, F.col("__row") == F.col("__keeper"), "left_semi").dropDuplicates(["__row"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return classes(spark, docs).select("doc_id", "class_id", "n_links", "n_copies")
