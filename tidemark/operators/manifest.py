"""A pipeline's manifest: numbered versions of one small JSON document on the shared storage.

A change writes its data first and then a new version that names it. The version appears whole or not at
all, so data, change log, batch numbers and row counts change together; files no version names are never read.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer changed the pipeline in a way that this change can't be laid on top of."""


class Files:
    """What the engine needs of the Hadoop file system behind a path."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self.path(root).getFileSystem(self._conf)

    def path(self, text: str):  # noqa: ANN201
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self.path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """False where the file is there already."""
        staged = self.path(f"{path}.{id(self)}.tmp")
        stream = self._fs.create(staged, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self._fs.exists(self.path(path)):
                return False
            return self._fs.rename(staged, self.path(path))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        finally:
            self._fs.delete(staged, False)

    def delete(self, path: str) -> None:
        self._fs.delete(self.path(path), True)

    def size(self, path: str) -> int:
        at = self.path(path)
        return self._fs.getContentSummary(at).getLength() if self._fs.exists(at) else 0


class Manifest:
    def __init__(self, spark: SparkSession, path: str):
        self.files, self.folder = Files(spark, path), f"{path}/manifest"

    def _version(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def latest(self) -> dict | None:
        found = [n for n in self.files.names(self.folder) if n.endswith(".json")]
        return json.loads(self.files.read(f"{self.folder}/{found[-1]}")) if found else None

    def change(self, how: Callable[[dict], dict | None], tries: int = 20) -> dict:
        """Lays `how` on the latest version; with another writer in between, on what that one left. None leaves all as it is."""
        for _ in range(tries):
            now = self.latest() or {"version": 0}
            then = how(json.loads(json.dumps(now)))
            if then is None:
                return now
            then["version"] = now["version"] + 1
            if self.files.create(self._version(then["version"]), json.dumps(then)):
                for old in self.files.names(self.folder)[:-3]:
                    self.files.delete(f"{self.folder}/{old}")
                return then
        raise Conflict(f"{self.folder}: {tries} other changes in a row")
