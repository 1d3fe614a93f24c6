"""Scans of registry tables and listings of their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspark.schemas import TABLES, table_schema


def scan_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Parquet scan of one registry table with its declared schema; absent columns are null."""
    return spark.read.schema(table_schema(name)).parquet(f"{root.rstrip('/')}/{name}")


def scan_table_jdbc(spark: SparkSession, options: dict[str, str], name: str, split: dict | None = None) -> DataFrame:
    """The same over JDBC.  ``split`` (column, lower, upper, partitions) reads in parallel ranges."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", name)
    if split:
        reader = reader.options(
            partitionColumn=split["column"], lowerBound=str(split["lower"]), upperBound=str(split["upper"]),
            numPartitions=str(split["partitions"]),
        )
    return conform(reader.load(), name)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of a table in declared order and type; missing ones are null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in table_schema(name)
    ])


def write_table(df: DataFrame, root: str, name: str, mode: str = "errorifexists") -> None:
    conform(df, name).write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def schema_listing(df: DataFrame, null_counts: bool = False) -> DataFrame:
    """(position, column_name, data_type, is_nullable) of a DataFrame's columns.

    With ``null_counts`` the nulls of all columns are counted in one pass over the table.
    """
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    listed = df.sparkSession.createDataFrame(
        rows, "position int, column_name string, data_type string, is_nullable boolean"
    )
    if not null_counts:
        return listed
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return listed.join(counts.unpivot([], df.columns, "column_name", "null_count"), "column_name")


def schema_diff(df: DataFrame, expected: T.StructType | str) -> DataFrame:
    """Columns against an expected schema or table name: ok, type_differs, missing or unexpected."""
    wanted = table_schema(expected) if isinstance(expected, str) and expected in TABLES else expected
    rows = [(f.name, f.dataType.simpleString()) for f in wanted]
    other = df.sparkSession.createDataFrame(rows, "column_name string, expected_type string")
    joined = schema_listing(df, null_counts=True).join(other, "column_name", "full_outer")
    state = (
        F.when(F.col("data_type").isNull(), "missing").when(F.col("expected_type").isNull(), "unexpected")
        .when(F.col("data_type") != F.col("expected_type"), "type_differs").otherwise("ok")
    )
    return joined.select("column_name", "data_type", "expected_type", "null_count", state.alias("state"))
