"""A stored listing of backup objects, kept up to date from what is new since the last look.

Listings of object stores are large and change little.  Each refresh reads only files changed since
the stored mark: exported listings (JSON lines) or the objects' own metadata.  New objects are added,
changed ones take the place of what was known, and the mark moves on in the same commit.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.functions.records import changed
from fleetspark.functions.text import BACKUP_BUCKET
from fleetspark.session import work_dir
from fleetspark.sources.snapshots import backup_objects, exported_objects
from fleetspark.sources.versions import VersionStore

#: File times are compared with this much overlap, since stores keep them in whole seconds at times.
OVERLAP = datetime.timedelta(seconds=2)
MODIFIED = "file_modified_at"


def described(objects: DataFrame) -> DataFrame:
    """Objects with ``depth`` (folders above the file) and ``suffix`` (after the last dot of the file name, '' without)."""
    last = F.substring_index("name", "/", -1)
    suffix = F.when(F.contains(last, F.lit(".")), F.substring_index(last, ".", -1)).otherwise("")
    return objects.withColumns({"depth": F.size(F.split("name", "/")) - 1, "suffix": suffix})


class Listing:
    """Objects by name below ``root``: a table ``objects`` and the mark, in versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, VersionStore(spark, root)

    def mark(self) -> datetime.datetime | None:
        """Time of the newest file that was read, in UTC; None before the first refresh with a file."""
        row = self.store.read("mark").first() if "mark" in self.store.lists() else None
        return row[MODIFIED] if row else None

    def objects(self, version: int | None = None) -> DataFrame:
        return self.store.read("objects", version)

    def refresh(self, read: Callable[[dict[str, str]], DataFrame]) -> dict[str, int]:
        """Merge what ``read(options)`` gives: rows with ``name`` and ``file_modified_at``, of files that the
        reader options admit.  Of several rows of one name the last by (updated_at, file time) counts.

        Returns how many objects were added and changed.  A refresh that fails or comes second leaves
        the listing as it was, and is simply run again.
        """
        mark = self.mark()
        options = {"modifiedAfter": f"{mark - OVERLAP:%Y-%m-%dT%H:%M:%S}", "timeZone": "UTC"} if mark else {}
        path = work_dir(self.spark, "listing")
        read(options).write.parquet(path)
        seen = self.spark.read.parquet(path)
        newest = F.max_by(F.struct(*seen.columns), F.struct(F.col("updated_at").isNotNull(), "updated_at", MODIFIED, "size_bytes"))
        fresh = seen.groupBy(F.col("name").alias("_name")).agg(newest.alias("_row")).select("_row.*")
        fields = [c for c in fresh.columns if c != MODIFIED]
        change = self.store.begin()
        if "objects" in self.store.lists():
            known = change.read("objects").select(F.col("name").alias("_known"), F.struct(*fields).alias("_old"))
            joined = fresh.join(known, F.col("name") == F.col("_known"), "left")
            new = joined.where(F.col("_known").isNull()).select(fields)
            moved = joined.where(F.col("_known").isNotNull() & changed(F.struct(*fields), F.col("_old"))).select(fields)
        else:
            new, moved = fresh.select(fields), fresh.select(fields).limit(0)
        parts = f"{path}-new", f"{path}-moved"
        for rows, part in zip((new, moved), parts):
            rows.write.parquet(part)
        new, moved = (self.spark.read.schema(fresh.select(fields).schema).parquet(p) for p in parts)
        counts = {"added": new.count(), "changed": moved.count()}
        if counts["changed"]:
            change.rewrite("objects", moved.select("name"), lambda rows: rows.join(moved.select("name"), "name", "left_anti").select(fields).unionByName(moved), ("name",))
        if counts["added"] or "objects" not in self.store.lists():
            change.append("objects", new, ("name",))
        last = seen.agg(F.max(MODIFIED).alias(MODIFIED))
        if last.first()[0] is not None:
            change.replace("mark", last)
            change.commit()
        elif "objects" not in self.store.lists():
            change.commit()
        return counts

    def refresh_from_exports(self, folder: str) -> dict[str, int]:
        """From exported listings, JSON lines."""
        return self.refresh(lambda options: exported_objects(self.spark, folder, options, MODIFIED))

    def refresh_from_files(self, root: str, bucket: str = BACKUP_BUCKET) -> dict[str, int]:
        """From the metadata of the objects below ``root``/projects/."""
        return self.refresh(lambda options: backup_objects(self.spark, root, bucket, options).withColumn(MODIFIED, F.col("updated_at")))

    def forget_missing(self, present: DataFrame) -> int:
        """Drop objects whose name a full listing does not have; how many.  New files say nothing of deleted ones."""
        gone = self.objects().select("name").join(present.select("name"), "name", "left_anti")
        path = work_dir(self.spark, "gone")
        gone.write.parquet(path)
        gone = self.spark.read.schema("name string").parquet(path)
        n = gone.count()
        if n:
            change = self.store.begin()
            change.rewrite("objects", gone, lambda rows: rows.join(gone, "name", "left_anti"), ("name",))
            change.commit()
        return n
