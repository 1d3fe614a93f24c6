"""Writes of the registry: metric rows, new clients, tokens, backups."""

from __future__ import annotations

import os
from itertools import groupby

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.functions.forms import INTAKE_PROJECT, client_record
from fleetspark.functions.text import backup_name, backup_url, python_strip
from fleetspark.functions.times import moment, token_expiry
from fleetspark.plans.ranking import top_per_key
from fleetspark.schemas import GENERATION_LOG_COLUMNS, table_schema
from fleetspark.sources.shared_files import SharedFolder


def generation_log_rows(runs: DataFrame) -> DataFrame:
    """Rows of the generation log: the eleven columns, seconds rounded to two digits."""
    kinds = {f.name: f.dataType for f in table_schema("site_generations")}
    present = set(runs.columns)
    columns = []
    for name in GENERATION_LOG_COLUMNS:
        value = F.col(name) if name in present else F.lit(None)
        if name == "generation_time_seconds":
            value = F.round(value, 2)
        columns.append(value.cast(kinds[name]).alias(name))
    return runs.select(*columns)


def append_generation_log(runs: DataFrame, folder: str) -> None:
    generation_log_rows(runs).write.mode("append").parquet(folder)


def clean_form(forms: DataFrame) -> DataFrame:
    """Form rows with all text fields stripped."""
    texts = [f.name for f in forms.schema if f.dataType.simpleString() == "string"]
    return forms.withColumns({name: python_strip(F.col(name)) for name in texts})


def new_clients(forms: DataFrame, clients: DataFrame, order: list[str], as_of, intake_project: str = INTAKE_PROJECT) -> DataFrame:
    """Client rows for forms whose slug is free; of several with one slug the first in ``order``."""
    taken = clients.select("client_slug")
    free = forms.join(taken, "client_slug", "left_anti")
    first = top_per_key(free, ["client_slug"], [F.col(c).asc() for c in order])
    first = first if "industry" in first.columns else first.withColumn("industry", F.lit(None).cast("string"))
    return first.select(*client_record(as_of, intake_project))


def insert_clients(forms: DataFrame, clients: DataFrame, order: list[str], folder: str, as_of) -> None:
    new_clients(forms, clients, order, as_of).write.mode("append").parquet(folder)


def issue_tokens(requests: DataFrame, as_of, token: Column | None = None) -> DataFrame:
    """One unused token per request (client_slug), valid for a day."""
    now = moment(as_of)
    secret = F.sha2(F.concat(F.uuid(), F.uuid()), 256) if token is None else token
    return requests.select(
        secret.alias("token"), "client_slug", now.alias("created_at"), token_expiry(now).alias("expires_at"),
        F.lit(False).alias("used"),
    )


def write_backups(files: DataFrame, folder: str, generated_at) -> None:
    """Snapshot of file records (project_name, path, content), one folder per project and moment.

    Rows are rebalanced by project: at run time large projects are split over
    several tasks and small ones share one.
    """
    stamp = F.date_format(moment(generated_at), "yyyyMMdd-HHmmss")
    rows = files.withColumn("generation_ts", stamp).hint("rebalance", "project_name")
    rows.write.mode("append").partitionBy("project_name", "generation_ts").parquet(folder)


#: What Spark writes as %XX in the name of a folder, besides control characters.
_ESCAPED = set("\"#%'*/:=?\\\x7f{[]^")


def folder_value(value: str | None) -> str:
    """A value as Spark's writer has it in the name of a folder column=value."""
    if not value:
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if c in _ESCAPED or ord(c) < 32 else c for c in value)


def write_owner_texts(rows: DataFrame, folder: str, owner: str, text: str) -> None:
    """One text file per ``owner``, a line for each of its rows, in folders owner=value; ``folder`` is new.

    Hadoop's local file system starts a process for every file it creates, some 20 ms each, so there the
    tasks write the files themselves.  Owners stay in their task and a file's name in its task's number,
    so a repeated task writes over what it left.  On other file systems Spark's own writer does it.
    """
    spark = rows.sparkSession
    root = SharedFolder(spark, folder).local_path()
    # Null and '' share a folder, so they are one owner.  Files count here, not bytes, so partitions are
    # not put together by their size.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.when(F.col(owner) != "", F.col(owner)).alias(owner), text).repartition(tasks, owner)
    if root is None:
        dealt.write.partitionBy(owner).text(folder)
        return

    def write(part) -> None:
        name = f"part-{TaskContext.get().partitionId():05d}.txt"
        for value, held in groupby(part, key=lambda r: r[0]):
            place = os.path.join(root, f"{owner}={folder_value(value)}")
            os.makedirs(place, exist_ok=True)
            with open(os.path.join(place, name), "wb") as f:
                f.writelines((r[1] or "").encode() + b"\n" for r in held)

    os.makedirs(root)
    dealt.sortWithinPartitions(owner).foreachPartition(write)


def backup_metadata(files: DataFrame, generated_at) -> DataFrame:
    """One row per project of a snapshot: object name, URL, files and bytes."""
    name = backup_name(F.col("project_name"), moment(generated_at))
    return files.groupBy("project_name").agg(
        F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes")
    ).select("project_name", name.alias("name"), backup_url(name).alias("backup_url"), "files", "bytes")
