"""Small text files in a shared folder, through the file system Spark itself uses."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class SharedFolder:
    """Names, texts and atomic publication below one folder, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._context = spark.sparkContext
        self._jvm = self._context._jvm
        self._conf = self._context._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def local_path(self) -> str | None:
        """The folder's path if it lies in the machine's own file system, mounted or not; else None."""
        return self._path("").toUri().getPath() if self._fs.getUri().getScheme() == "file" else None

    def names(self, folder: str = "") -> list[str]:
        """Names in a folder, sorted; none if it does not exist."""
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        return sorted(status.getPath().getName() for status in self._fs.listStatus(path))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str, replace: bool = False) -> bool:
        """Write a text under a name in one step: readers see all of it or nothing.

        Without ``replace`` an existing file stays, and the answer is False.
        """
        folder, _, last = name.rpartition("/")
        draft, target = self._path(f"{folder}/.{last}.{uuid.uuid4().hex}"), self._path(name)
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        flags = self._context._gateway.new_array(rename, int(replace))
        if replace:
            flags[0] = rename.OVERWRITE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(draft, target, flags)
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if not replace and "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, name: str) -> bool:
        """Delete a file or folder below the root; False if there was none."""
        if not name.strip("/"):
            raise ValueError("the folder itself is not deleted")
        return self._fs.delete(self._path(name), True)
