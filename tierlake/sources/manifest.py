"""Numbered states of derived or stored data, each one small file; a new state is made by whoever creates its file first."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from .tables import ConflictError


class Manifest:
    """A folder of files N.json. What a state does not name does not count, so a write that is cut off before its state leaves nothing.

    ``commit`` fails with ConflictError if another writer has made the next state meanwhile. The latest ``keep`` states stay.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 8):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        system, folder = self._path()
        if not system.exists(folder):
            return []
        names = [f.getPath().getName() for f in system.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self) -> tuple[int, dict]:
        """The latest state and its number; 0 and an empty one if there is none."""
        numbers = self._numbers()
        if not numbers:
            return 0, {}
        system, path = self._path(f"{numbers[-1]}.json")
        stream = system.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return numbers[-1], json.loads(text)

    def commit(self, after: int, state: dict) -> int:
        """Make ``state`` the one that follows state number ``after``."""
        if after + 1 in (numbers := self._numbers()) or numbers and numbers[-1] > after:
            raise ConflictError(f"state {after} of {self.folder} is not the latest")
        system, path = self._path(f"{after + 1}.json")
        try:
            stream = system.create(path, False)
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                raise ConflictError(f"state {after + 1} of {self.folder} was made by another writer") from e
            raise
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        for n in numbers[: -self.keep]:
            old_system, old = self._path(f"{n}.json")
            old_system.delete(old, False)
        return after + 1
