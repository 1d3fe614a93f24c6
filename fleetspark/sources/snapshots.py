"""Listings of outside systems, read from exported JSON or from object storage."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.functions.text import BACKUP_BUCKET
from fleetspark.schemas import BACKUP_OBJECT, PROJECT, REPOSITORY


def repo_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Repository listing out of exported JSON lines."""
    return spark.read.schema(REPOSITORY).json(folder)


def project_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Hosting-project listing out of exported JSON lines."""
    return spark.read.schema(PROJECT).json(folder)


def project_details(projects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Projects asked for by id or name (project_id), with an error text where there is none."""
    asked = wanted.select("project_id").distinct()
    keys = F.array_distinct(F.array("id", "name"))
    by_key = projects.select(F.explode(keys).alias("_key"), "*").filter(F.col("_key").isNotNull())
    joined = asked.join(by_key, F.col("project_id") == F.col("_key"), "left")
    missing = F.when(F.col("_key").isNull(), F.concat(F.lit("Project not found: "), F.col("project_id")))
    return joined.withColumn("error", missing).drop("_key")


def exported_objects(spark: SparkSession, folder: str, options: dict[str, str] | None = None, modified: str | None = None) -> DataFrame:
    """Backup objects out of an exported listing (JSON lines); the slug is the first folder below ``projects/``.

    ``options`` are further ones of the reader; ``modified`` names a column for the time of an object's file (UTC).
    """
    listed = spark.read.schema(BACKUP_OBJECT).options(**(options or {})).json(folder)
    if modified:
        listed = listed.select("*", F.to_utc_timestamp("_metadata.file_modification_time", spark.conf.get("spark.sql.session.timeZone")).cast("timestamp_ntz").alias(modified))
    return listed.withColumn("client_slug", F.regexp_extract("name", "^projects/([^/]+)/", 1)).filter(F.col("client_slug") != "")


def backup_objects(spark: SparkSession, root: str, bucket: str = BACKUP_BUCKET, options: dict[str, str] | None = None) -> DataFrame:
    """Every object below ``root``/projects/{slug}/, of any suffix and depth, from file metadata alone.

    The name is the path from ``projects/`` on, the slug its first folder.  File systems keep one
    time per file, which stands for creation and change.  A public address needs the bucket's
    access rules, so it is null.  Spark's scan leaves out files without any byte; a listing that
    must hold them is read with ``exported_objects``.  ``options`` are further ones of the reader.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").options(**(options or {})).load(f"{root.rstrip('/')}/projects")
    base = re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", root.rstrip("/"))
    name = F.regexp_extract("path", rf"\Q{base}\E/(projects/.*)$", 1)
    at = F.col("modificationTime").cast("timestamp_ntz")
    listed = files.select(
        name.alias("name"), F.regexp_extract(name, "^projects/([^/]+)/", 1).alias("client_slug"), F.col("length").alias("size_bytes"),
        at.alias("created_at"), at.alias("updated_at"), F.concat(F.lit(f"gs://{bucket}/"), name).alias("url"), F.lit(None).cast("string").alias("public_url"),
    )
    return listed.filter(F.col("client_slug") != "")
