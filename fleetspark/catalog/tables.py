"""Registry tables over one folder of given test tables, for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fleetspark.fixtures import TABLE_SQL
from fleetspark.schemas import GIVEN

AS_OF = "2024-01-31 00:00:00"
_SOURCE = re.compile(rf"\bFROM ({'|'.join(GIVEN)})\b")


class RegistryTables:
    """Lazy DataFrames, one per registry table: ``RegistryTables(spark, folder).clients``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def given(self, name: str) -> DataFrame:
        return self.spark.read.schema(GIVEN[name]).parquet(f"{self.folder}/{name}.parquet")

    def _derive(self, name: str, source: str, rows: DataFrame, kind: str) -> DataFrame:
        # The view is bound when the text is analysed, so replacing it later does no harm.
        view = f"{kind}_{source}"
        rows.createOrReplaceTempView(view)
        text = TABLE_SQL[name].replace("timestamp '", "timestamp_ntz '")
        return self.spark.sql(_SOURCE.sub(f"FROM {view}", text))

    def stream(self, name: str) -> DataFrame:
        """A table as a stream over the files of its source table."""
        source = _SOURCE.search(TABLE_SQL[name])[1]
        # As a pattern the path may be one file or a folder of files.
        rows = self.spark.readStream.schema(GIVEN[source]).parquet(f"{self.folder}/{source}.parque[t]")
        return self._derive(name, source, rows, "stream_of")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_SQL:
            raise AttributeError(name)
        source = _SOURCE.search(TABLE_SQL[name])[1]
        return self._derive(name, source, self.given(source), "given")


def with_tables(sql: str) -> str:
    """DuckDB text: the registry tables that ``sql`` names, then ``sql`` itself."""
    used = [name for name in TABLE_SQL if re.search(rf"\b{name}\b", sql)]
    ctes = [f"{name} AS ({TABLE_SQL[name].strip()})" for name in used]
    body = sql.strip()
    if re.match(r"(?i)with\b", body):
        body = re.sub(r"(?i)^with\s+", "", body)
        return "WITH " + ",\n".join(ctes) + ",\n" + body if ctes else "WITH " + body
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body
