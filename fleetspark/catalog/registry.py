"""The registered queries: name, Spark query and, where SQL can say it, a DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspark.catalog.tables import AS_OF, RegistryTables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Values any engine prints alike: string arrays joined by '|', decimals as double."""
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, "|").alias(f.name)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double").alias(f.name)
        columns.append(c)
    return df.select(*columns)


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name; ``{now}`` in the SQL is the current time."""

    def add(fn: Callable[[RegistryTables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: plain(fn(RegistryTables(spark, folder)))
        if oracle is not None:
            ORACLES[name] = with_tables(oracle.replace("{now}", f"timestamp '{AS_OF}'"))
        return fn

    return add
