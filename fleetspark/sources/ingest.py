"""JSON keys as columns: extracted once when rows are written, read and pushed down like any column.

Declared keys of a JSON text are stored beside it as ``<text>__<key>``.  ``json_key`` and ``json_value``
take the stored column where a table has it and read the text where it has not, so the same
operators run on both kinds of table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspark.functions.records import changed, computed_once, extracted_name, json_text
from fleetspark.schemas import table_schema
from fleetspark.sources.registry import conform

#: Keys that lookups, joins and views of the registry read, by table and JSON column.
HOT_KEYS = {
    "deleted_sites": {"client_data": {"client_slug": "string", "client_name": "string"}},
    "platform_inventory": {"resource_metadata": {
        "last_commit_sha": "string", "deployment_state": "string", "content_count": "string", "latest_backup_at": "string", "backup_count": "bigint",
    }},
    "registry_operations_log": {f"{platform}_result": {"success": "string"} for platform in ("github", "vercel", "builder", "gcs", "supabase")},
}


def extracted(df: DataFrame, keys: dict[str, dict[str, str]]) -> DataFrame:
    """``df`` with a column per declared key (JSON column -> key -> type).

    A value that is not of the declared type is null; JSON null, a missing key and broken JSON are too.
    """
    columns = {}
    for doc, wanted in keys.items():
        for key, kind in wanted.items():
            text = json_text(F.col(f"`{doc}`"), key)
            columns[extracted_name(doc, key)] = text if kind == "string" else text.try_cast(kind)
    # A consumer's filter on a key does not parse the text again.
    return computed_once(df.drop(*columns), **columns)


def ingest_schema(name: str, keys: dict[str, dict[str, str]] | None = None) -> T.StructType:
    keys = HOT_KEYS[name] if keys is None else keys
    more = ", ".join(f"{extracted_name(doc, key)} {kind}" for doc, wanted in keys.items() for key, kind in wanted.items())
    return T.StructType([*table_schema(name).fields, *T.StructType.fromDDL(more)])


def write_ingested(df: DataFrame, root: str, name: str, keys: dict[str, dict[str, str]] | None = None, cluster: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Write a registry table with its hot keys.  ``cluster`` (column names, extracted ones too) orders the
    rows by range, so that a filter on them reads few row groups."""
    rows = extracted(conform(df, name), HOT_KEYS[name] if keys is None else keys)
    if cluster:
        rows = rows.repartitionByRange(*cluster).sortWithinPartitions(*cluster)
    rows.write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def scan_ingested(spark: SparkSession, root: str, name: str, keys: dict[str, dict[str, str]] | None = None) -> DataFrame:
    return spark.read.schema(ingest_schema(name, keys)).parquet(f"{root.rstrip('/')}/{name}")


def stale_rows(df: DataFrame, name: str, keys: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Rows whose stored keys are not what their JSON says: written around the ingest."""
    keys = HOT_KEYS[name] if keys is None else keys
    names = [extracted_name(doc, key) for doc, wanted in keys.items() for key in wanted]
    both = extracted(df.withColumnsRenamed({n: f"_stored_{n}" for n in names}), keys)
    differs = F.lit(False)
    for n in names:
        differs = differs | changed(F.col(n), F.col(f"_stored_{n}"))
    return both.where(differs).drop(*[f"_stored_{n}" for n in names])
