"""Token-id store: fixed-size id blocks as compressed bit planes, with a chunk index.

A store is a folder of two Parquet tables.  ``chunks`` has a row per block of at most
``BLOCK`` ids: shard, block, n_ids, width, the planes (one zstandard frame each) and the
documents that lie in it, in order.  ``index`` has each block's place among all ids and the
size of its planes.  Spark's committer writes both, so a lost executor leaves no half file.
"""

from __future__ import annotations

import array
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
LEVEL = 3
#: Documents whose ids end with this id.
END_ID = 2
#: Parts remembered per task, and the longest of them in characters; a full memory is cleared, and
#: longer ones are encoded again, which changes no result.
MEMORY, LONGEST = 400_000, 64
#: Bytes of text encoded at once; a longer text is encoded alone.
SLICE = 1 << 22
CHUNK_SCHEMA = (
    "shard int, block int, n_ids int, width int, planes array<binary>, doc_nos array<long>, doc_ids array<long>, "
    "lengths array<int>, begins array<boolean>, ends array<boolean>"
)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def to_planes(ids: np.ndarray, unit: str = "bit", level: int = LEVEL) -> tuple[int, list[bytes]]:
    """(number of planes, compressed planes), lowest first: as many as the largest id needs."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=level)
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    if unit == "byte":
        raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4).T
        return -(-bits // 8) * 8, [packer.compress(np.ascontiguousarray(raw[k]).tobytes()) for k in range(-(-bits // 8))]
    return bits, [packer.compress(np.packbits((ids >> np.uint32(k) & np.uint32(1)).astype(np.uint8)).tobytes()) for k in range(bits)]


def from_planes(n: int, width: int, planes: list[bytes]) -> np.ndarray:
    """Ids of a block; fewer planes than bits means byte planes."""
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    ids = np.zeros(n, "<u4")
    each = 1 if len(planes) == width else 8
    for k, plane in enumerate(planes):
        raw = np.frombuffer(unpacker.decompress(plane, max_output_size=max(n, 1)), np.uint8)
        ids |= (np.unpackbits(raw, count=n) if each == 1 else raw).astype("<u4") << np.uint32(k * each)
    return ids


# Letters and marks that start no contraction: the vocabulary's pattern always parts them, and
# lower-cases the letters one by one.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _encoder(path: str):
    """Texts (a list or an Arrow array) -> their little-endian ids by the library.

    The vocabulary drops white space and no piece spans any, so each part between blanks or line ends
    is encoded once and remembered.  Parts of a word and marks are what the vocabulary's normalizer and
    pattern leave as they are but for case, so these go to its model at once, all others the whole way.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    model, letters = tokenizer.model, _byte_letters()
    pieces: dict[str, bytes] = {}
    memory: dict[str, bytes] = {}

    def learn(parts: list[str]) -> None:
        if len(memory) + len(parts) > MEMORY:
            memory.clear()
        if len(pieces) + len(parts) > MEMORY:
            pieces.clear()
        whole, long = [], []
        for p in parts:
            m = _SIMPLE.fullmatch(p)
            if not m:
                whole.append(p)
                continue
            ids = b""
            for piece in (m[1].lower(), m[2]):
                if piece not in pieces:
                    plain = piece if piece.isascii() else piece.translate(letters)
                    pieces[piece] = array.array("I", [t.id for t in model.tokenize(plain)]).tobytes()
                    if len(piece) > LONGEST:
                        long.append(piece)
                ids += pieces[piece]
            memory[p] = ids
        for p, e in zip(whole, tokenizer.encode_batch_fast(whole, add_special_tokens=False)):
            memory[p] = array.array("I", e.ids).tobytes()
        for piece in long:
            del pieces[piece]

    def encode(texts: list[str] | pa.Array) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        missing = [p for p in parts if p not in memory]
        if len(memory) + len(missing) > MEMORY:
            missing = parts
        learn(missing)
        # The ids of different parts lie behind one another; each part of a text takes its span of them.
        known = [memory[p] for p in parts]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at, ids = coded.indices.to_numpy(), np.frombuffer(b"".join(known), "<u4")
        ends = np.cumsum(sizes[at])
        shift = (np.cumsum(sizes) - sizes)[at] - (ends - sizes[at])
        found = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(shift, sizes[at])]
        cuts = np.append(0, ends)[np.cumsum(np.append(0, pc.list_value_length(split).to_numpy()))]
        for p in missing:
            if len(p) > LONGEST:
                del memory[p]
        return [found[s:e].tobytes() for s, e in zip(cuts, cuts[1:])]

    return encode


def _byte_letters() -> dict[int, str]:
    """Letter -> what stands for its bytes in byte-level vocabularies, from the library, for all letters of ``_SIMPLE``."""
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    return {c: split(chr(c))[0][0] for c in range(256) if chr(c).isalpha()}


def _encoded(encode, batch, end: bytes):
    """(doc_id, ids) of a batch, encoding some megabytes of text at a time."""
    ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(ids):
        last = first + 1 + int(np.searchsorted(ends[first + 1 :], (ends[first - 1] if first else 0) + SLICE, "right"))
        yield from zip(ids[first:last], [x + end for x in encode(texts.slice(first, last - first))])
        first = last


def write(docs: DataFrame, folder: str, path: str | None = None, unit: str = "bit") -> None:
    """Encode every text (null: empty) and write the store in ascending doc_id order.

    Null ids come first; rows with the same id are ordered by a hash of the text and the text.
    Every document ends with ``END_ID``.  An empty table gives a store without blocks.
    """
    path = path or vocabulary_path()
    tie = F.xxhash64("text")
    order = [F.col("doc_id").asc_nulls_first(), tie.asc(), F.col("text").asc_nulls_first()]
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(order[0], order[1]).sortWithinPartitions(*order)

    def blocks(batches):
        encode = _encoder(path)
        shard, block, doc_no = TaskContext.get().partitionId(), 0, 0
        parts, fragments, held = [], [], 0

        def cut():
            nonlocal block, parts, fragments, held
            ids = np.frombuffer(b"".join(parts), "<u4")
            width, planes = to_planes(ids, unit)
            nos, doc_ids, lengths, begins, ends = zip(*fragments)
            out = pa.RecordBatch.from_pylist([{
                "shard": shard, "block": block, "n_ids": len(ids), "width": width, "planes": planes, "doc_nos": nos,
                "doc_ids": doc_ids, "lengths": lengths, "begins": begins, "ends": ends,
            }], schema=arrow)
            block, parts, fragments, held = block + 1, [], [], 0
            return out

        arrow = pa.schema([
            ("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int32()), ("width", pa.int32()), ("planes", pa.list_(pa.binary())),
            ("doc_nos", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
            ("begins", pa.list_(pa.bool_())), ("ends", pa.list_(pa.bool_())),
        ])
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for doc_id, ids in _encoded(encode, batch, end):
                at = 0
                while at < len(ids):
                    piece = ids[at : at + 4 * (BLOCK - held)]
                    parts.append(piece)
                    fragments.append((doc_no, doc_id, len(piece) // 4, at == 0, at + len(piece) == len(ids)))
                    held += len(piece) // 4
                    at += len(piece)
                    if held == BLOCK:
                        yield cut()
                doc_no += 1
        if held:
            yield cut()

    rows.mapInArrow(blocks, CHUNK_SCHEMA).write.option("compression", "none").parquet(f"{folder}/chunks")
    spark = docs.sparkSession
    blocks_written = spark.read.schema(CHUNK_SCHEMA).parquet(f"{folder}/chunks")
    sizes = blocks_written.select("shard", "block", "n_ids", "width", F.transform("planes", lambda p: F.octet_length(p)).alias("plane_bytes"))
    # One row per shard, so the running sum over shards is small; within a shard blocks are full but the last.
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = shards.select("shard", F.coalesce(before, F.lit(0)).alias("shard_first"))
    (
        sizes.join(starts, "shard").withColumn("first_id", F.col("shard_first") + F.col("block").cast("long") * BLOCK)
        .select("shard", "block", "first_id", "n_ids", "width", "plane_bytes").write.parquet(f"{folder}/index")
    )


INDEX_SCHEMA = "shard int, block int, first_id long, n_ids int, width int, plane_bytes array<int>"
PIECE_SCHEMA = "shard int, block int, doc_no long, doc_id long, at int, n long, whole boolean, crc long, ids binary"


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of a store: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian bytes)."""

    def unpacked(batches):
        schema = pa.schema([
            ("shard", pa.int32()), ("block", pa.int32()), ("doc_no", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()),
            ("n", pa.int64()), ("whole", pa.bool_()), ("crc", pa.int64()), ("ids", pa.binary()),
        ])
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r].as_py() for name in batch.schema.names}
                ids = from_planes(row["n_ids"], row["width"], row["planes"]).tobytes()
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                pieces = [ids[4 * s : 4 * e] for s, e in zip(starts, ends)]
                whole = [b and e for b, e in zip(row["begins"], row["ends"])]
                n = len(pieces)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(row["doc_nos"], pa.int64()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int32()), pa.array(row["lengths"], pa.int64()), pa.array(whole),
                    pa.array([zlib.crc32(p) if w else None for p, w in zip(pieces, whole)], pa.int64()),
                    pa.array([None if w and not with_ids else p for p, w in zip(pieces, whole)], pa.binary()),
                ], schema=schema)

    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{folder}/chunks")
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index").select("shard", "block", "first_id")
    pieces = chunks.mapInArrow(unpacked, PIECE_SCHEMA).join(index, ["shard", "block"])
    # Documents that lie in one block are read as they are; only the others are put together.
    joined = F.aggregate(F.array_sort(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("block", "ids")))), F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    docs = pieces.groupBy("shard", "doc_no").agg(
        F.first("doc_id").alias("doc_id"), F.min(F.col("first_id") + F.col("at")).alias("start"), F.sum("n").alias("n_tokens"),
        F.max("crc").alias("crc"), joined.alias("ids"),
    )
    out = docs.select("doc_id", "start", "n_tokens", F.coalesce("crc", F.crc32("ids")).alias("ids_crc32"), *(["ids"] if with_ids else []))
    return out


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    from fleetspark.session import work_dir

    folder = work_dir(spark, "token-store")
    write(docs, folder)
    return read(spark, folder)
