"""From raw documents to token ids: quality, repeated lines, near-duplicates, benchmark leaks, BPE.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the
next stage's documents.  All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm import bpe, line_dedup, quality, set_join, tiling
from fleetspark.llm.tables import table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; without labels all score alike and stay."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line once in the whole corpus; documents that lose all their lines go, documents without any stay."""
    return line_dedup.keep_lines(spark, docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; wordless documents stay."""
    return set_join.keep_first(spark, docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not contain a benchmark item."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, their number, and whether decoding gives the text back (null: empty)."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_tokens", "intact")])
    out = bpe.tokens(kept)
    return out.select("*", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("intact")).drop("decoded")


STAGES = [
    ("quality_classifier", good_documents), ("line_dedup", distinct_lines), ("ngram_jaccard_join", distinct_documents),
    ("benchmark_decontamination", clean_of_benchmark), ("bpe", encoded),
]

#: A trained classifier, MinHash and BPE have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), spark, f"stage-{name}")
    return docs
