"""Helpers the text operators share: given tables, work folders, bounded labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.session import work_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


#: Spark's setting by which a query's shuffle files go as soon as it has ended, not when the driver happens to collect garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, spark: SparkSession, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage and its shuffle files end there."""
    path = work_dir(spark, purpose)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        # The setting holds for frames planned from now on, so for this write even if ``df`` is older.
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that ``written`` has returned, once nothing reads them any more; other frames are left alone."""
    jvm, conf, root = spark._jvm, spark._jsc.hadoopConfiguration(), work_dir(spark, "")
    path = jvm.org.apache.hadoop.fs.Path
    root = path(root).getParent()
    for folder in {file.rpartition("/")[0] for df in frames for file in df.inputFiles()}:
        folder = path(jvm.java.net.URI(folder))
        store = folder.getFileSystem(conf)
        if folder.getParent().equals(store.makeQualified(root)):
            store.delete(folder, True)


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """At most ``rows`` labelled training documents (doc_id, text, label), chosen by a hash of
    the id.  Several labels of one id count as the lowest, several texts as the smallest."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(fold_of(F.col("doc_id"), folds) != held_out)
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # ``known`` has at most ``rows`` pairs of numbers, so it may be broadcast.
    return (
        docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    )


def row_key(df: DataFrame) -> Column:
    """128 bits that name a row by all its columns: rows with the same key are full copies.

    Hashes skip nulls, so each column comes with a mark of whether it is.
    """
    names = sorted(df.columns, key=lambda c: (c not in ("doc_id", "text"), c))
    columns = [x for c in names for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    halves = [F.xxhash64(*columns), F.xxhash64(F.lit(77), *columns)]
    return F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves]))


#: Size up to which a side may be broadcast, once it has been counted.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A counted frame, marked for broadcast only if it is surely small; larger ones are shuffled."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


#: White space that splits words: blank, tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator, so that later expressions read them instead of repeating them."""
    fields = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select("*", F.inline(fields))
