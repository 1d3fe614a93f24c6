"""Latest-row and top-n plans.

``row_number() <= n`` lets Spark keep n rows per key in every input partition
before the shuffle (WindowGroupLimit), so a key that holds most of the rows
sends only n rows per partition to the task that ranks it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_first(at: str, tie: str) -> list[Column]:
    """Newest first with nulls as the newest; ties go to the smaller id."""
    return [F.col(at).desc_nulls_first(), F.col(tie).asc()]


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """First n rows of every key; ``rank`` names the position column to keep."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def nth_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The n-th row of every key that has so many."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") == n).drop("_rank")
