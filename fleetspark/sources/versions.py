"""Tables in versions: changes of several tables that become visible together.

A change writes its data files first, with Spark's writers, into folders of its own.  Then it
publishes one small file, the next version, which names each table's list of files.  Until
that moment, and for ever if the change fails, readers see the version before.  A change of
few rows rewrites only the files that hold them and carries the others over by name.

    store = VersionStore(spark, "s3a://registry/store")
    change = store.begin()
    change.rewrite("clients", slugs, lambda part: soft_delete(part, requests, now)[0])
    change.append("deleted_sites", deleted)
    version = change.commit()
    store.read("clients", version - 1)    # as it was before
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from fleetspark.sources.shared_files import SharedFolder


class CommitConflict(Exception):
    """Another change was published since this one began; begin again on the newest version."""


class VersionStore:
    """Below ``root``: data/<table>/<change>/ files, lists/ of files, versions/ that name the lists."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = SharedFolder(spark, self.root)

    def versions(self) -> list[int]:
        return [int(name[:-5]) for name in self.folder.names("versions") if name.endswith(".json") and not name.startswith(".")]

    def latest(self) -> int:
        """The newest version; 0 before the first change."""
        return max(self.versions(), default=0)

    def lists(self, version: int | None = None) -> dict[str, str]:
        """Table -> its list, in a version."""
        version = self.latest() if version is None else version
        return json.loads(self.folder.read(f"versions/{version:020d}.json")) if version else {}

    def _list(self, table: str, version: int | None) -> dict:
        lists = self.lists(version)
        if table not in lists:
            raise KeyError(f"no table {table} in this version")
        return json.loads(self.folder.read(f"lists/{lists[table]}"))

    def files(self, table: str, version: int | None = None) -> list[str]:
        """Data files of a table, as <change>/<file>."""
        return self._list(table, version)["files"]

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as it is in a version, by default the newest."""
        found = self._list(table, version)
        return self.frame(table, found["files"], StructType.fromJson(found["schema"]))

    def frame(self, table: str, files: list[str], schema: StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{table}/{f}" for f in files])

    def begin(self) -> Change:
        return Change(self, self.latest())

    def unreferenced(self) -> list[str]:
        """Data folders of failed or conflicting changes: no file of theirs is in any version."""
        used = set()
        for version in self.versions():
            for table in self.lists(version):
                used |= {f"{table}/{f.split('/')[0]}" for f in self.files(table, version)}
        present = [f"{table}/{change}" for table in self.folder.names("data") for change in self.folder.names(f"data/{table}")]
        return [p for p in present if p not in used]


class Change:
    """One change of any number of tables, on top of the version it began with."""

    def __init__(self, store: VersionStore, base: int):
        self.store, self.base, self.id = store, base, uuid.uuid4().hex
        self._lists = store.lists(base)
        self._new: dict[str, dict] = {}
        self._parts = 0

    def _found(self, table: str) -> dict:
        """List of a table as this change has it so far."""
        if table in self._new:
            return self._new[table]
        if table not in self._lists:
            return {"schema": None, "files": []}
        return json.loads(self.store.folder.read(f"lists/{self._lists[table]}"))

    def read(self, table: str) -> DataFrame:
        """A table with what this change did to it so far."""
        found = self._found(table)
        return self.store.frame(table, found["files"], StructType.fromJson(found["schema"]))

    def _write(self, table: str, frame: DataFrame, cluster: tuple[str, ...], files: int | None = None) -> list[str]:
        self._parts += 1
        name = f"{self.id}-{self._parts}"
        if cluster:
            # Rows of one key, or of none, may be too many for one task: a hash of the row deals them on.
            plain = [F.col(f"`{f.name}`") for f in frame.schema if not isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType))]
            spread = [F.xxhash64(*plain)] if plain else []
            frame = frame.repartitionByRange(*([files] if files else []), *cluster, *spread).sortWithinPartitions(*cluster)
        frame.write.parquet(f"{self.store.root}/data/{table}/{name}")
        return [f"{name}/{f}" for f in self.store.folder.names(f"data/{table}/{name}") if f.endswith(".parquet")]

    def replace(self, table: str, frame: DataFrame, cluster: tuple[str, ...] = (), files: int | None = None) -> None:
        """All rows anew.  ``cluster`` sorts them into files by range, so that later changes by these columns
        touch few; into ``files`` of them, or as many as the session's advisory partition size makes."""
        self._new[table] = {"schema": frame.schema.jsonValue(), "files": self._write(table, frame, cluster, files)}

    def append(self, table: str, frame: DataFrame, cluster: tuple[str, ...] = ()) -> None:
        """More rows; columns that the table has not are added, and are null in its older rows."""
        found = self._found(table)
        schema = StructType.fromJson(found["schema"]) if found["schema"] else StructType()
        known = {f.name: f.dataType for f in schema}
        for f in frame.schema:
            if f.name not in known:
                schema = StructType([*schema.fields, f])
            elif known[f.name] != f.dataType:
                raise ValueError(f"{table}.{f.name} is {known[f.name].simpleString()}, not {f.dataType.simpleString()}")
        self._new[table] = {"schema": schema.jsonValue(), "files": found["files"] + self._write(table, frame, cluster)}

    def rewrite(self, table: str, hit: Column | DataFrame, change: Callable[[DataFrame], DataFrame], cluster: tuple[str, ...] = ()) -> list[str]:
        """Change the rows that ``hit`` names, a condition or a table of keys under the table's own column names.

        ``change`` gets the rows of all files that hold such a row and returns what takes their place, in as
        many files.
        Returns the files that were replaced; all others are carried over.
        """
        found = self._found(table)
        if not found["files"]:
            return []
        schema = StructType.fromJson(found["schema"])
        rows = self.store.frame(table, found["files"], schema).select("*", F.substring_index("_metadata.file_path", "/", -2).alias("_file"))
        held = rows.where(hit) if isinstance(hit, Column) else rows.join(hit.distinct(), hit.columns, "left_semi")
        # Names of files: as many as the list has at most.
        touched = {r["_file"] for r in held.select("_file").distinct().collect()}
        if touched:
            changed = change(self.store.frame(table, sorted(touched), schema)).select(*schema.fieldNames())
            new = self._write(table, changed, cluster, len(touched))
            self._new[table] = {"schema": found["schema"], "files": [f for f in found["files"] if f not in touched] + new}
        return sorted(touched)

    def drop(self, table: str) -> None:
        """The table is no part of the new version."""
        self._new.pop(table, None)
        self._lists.pop(table, None)

    def commit(self) -> int:
        """Publish all of it at once; the new version.  CommitConflict if another change came first."""
        lists = dict(self._lists)
        for table, found in self._new.items():
            lists[table] = f"{table}-{self.id}.json"
            self.store.folder.publish(f"lists/{lists[table]}", json.dumps(found))
        version = self.base + 1
        if not self.store.folder.publish(f"versions/{version:020d}.json", json.dumps(lists)):
            raise CommitConflict(f"version {version} exists")
        return version


def commit(store: VersionStore, frames: dict[str, DataFrame], cluster: dict[str, tuple[str, ...]] | None = None) -> int:
    """Publish whole new tables together; the new version."""
    change = store.begin()
    for table, frame in frames.items():
        change.replace(table, frame, (cluster or {}).get(table, ()))
    return change.commit()
