"""Registered queries of the text operators, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetspark.llm import bpe, cube_mix, langid, line_dedup, pair_bitmaps, quality, rules, set_join, tiling, token_store, toxicity, urls, vertical_scan
from fleetspark.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": lambda spark, d: quality.op1(spark, table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_line_dedup": lambda spark, d: line_dedup.op2(spark, table(spark, d, "documents")),
    "op3_token_store": lambda spark, d: token_store.op3(spark, table(spark, d, "documents")),
    "op4_ngram_jaccard_join": lambda spark, d: set_join.op4(spark, table(spark, d, "documents")),
    "op5_benchmark_decontamination": lambda spark, d: tiling.op5(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op6_language_id": lambda spark, d: langid.op6(table(spark, d, "documents")),
    "op7_bpe_round_trip": lambda spark, d: bpe.op7(table(spark, d, "documents")),
    "op8_toxicity": lambda spark, d: toxicity.op8(table(spark, d, "documents"), table(spark, d, "labels")),
    "op9_quality_rules": lambda spark, d: rules.op9(table(spark, d, "documents")),
    "op10_url_filter": lambda spark, d: urls.op10(spark, table(spark, d, "pages")),
    "op11_cube_mix": lambda spark, d: cube_mix.op11(spark, table(spark, d, "documents")),
    "op12_hard_negatives": lambda spark, d: vertical_scan.op12(table(spark, d, "embeddings")),
    "op13_pair_bitmaps": lambda spark, d: pair_bitmaps.op13(table(spark, d, "documents")),
}
ORACLES: dict[str, str] = {"op9_quality_rules": rules.ORACLE, "op10_url_filter": urls.ORACLE, "op12_hard_negatives": vertical_scan.ORACLE}
