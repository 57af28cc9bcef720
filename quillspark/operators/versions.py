"""States of a folder: a base and changes to it, in order.

A state is a numbered pointer file that lists its folders. It is renamed into place, never overwritten, and readers take the one with the
greatest number: they see the old state or the new one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Changes that a state has at most.
MOST_CHANGES = 16


class Versions:
    """Writers are expected to take turns; a second one at the same time fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop.Path

    def _pointers(self) -> list[str]:
        fs, path = self._fs()
        found = fs.globStatus(path(f"{self.path}/state-*"))
        return sorted(f.getPath().getName() for f in found) if found else []

    def version(self) -> str | None:
        """The name of the state that readers see."""
        return (self._pointers() or [None])[-1]

    def folders(self) -> list[str]:
        """The state's base and changes, in order."""
        name = self.version()
        if name is None:
            return []
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def point_to(self, folders: list[str]) -> str:
        fs, path = self._fs()
        before = self._pointers()
        name = f"state-{int(before[-1][6:]) + 1 if before else 0:012d}"
        new = path(f"{self.path}/.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(" ".join(folders).encode())
        out.close()
        if fs.exists(path(f"{self.path}/{name}")) or not fs.rename(new, path(f"{self.path}/{name}")):
            raise RuntimeError(f"another writer has made {name} of {self.path}")
        for old in before[:-1]:  # readers may have the last one in hand
            fs.delete(path(f"{self.path}/{old}"), False)
        return name
