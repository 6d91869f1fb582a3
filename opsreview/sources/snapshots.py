"""Numbered snapshots of a folder: what a reader sees is one small file.

Data files are written under names of their own first. A snapshot file then names all that belongs to the
new state; it appears whole or not at all, and only if no other writer has taken its number. A writer that
dies half way leaves files that no snapshot names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class SnapshotTaken(RuntimeError):
    """Another writer has published this number: start again from the newest snapshot."""


class Snapshots:
    """The snapshots below ``<folder>/_snapshots``, on any file system whose rename refuses an existing target.

    The folder begins with an underscore, so Spark's readers of ``folder`` do not see it. The content of a
    snapshot is JSON of bounded size: names of folders, never of rows.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = f"{folder.rstrip('/')}/_snapshots"
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def numbers(self) -> list[int]:
        """Published numbers in ascending order."""
        if not self._fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json"))

    def newest(self) -> int:
        """The newest number, 0 where nothing is published."""
        return max(self.numbers(), default=0)

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{number}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, number: int, content: dict) -> None:
        """Publish ``number``; ``SnapshotTaken`` where it exists already."""
        draft = self._path(f"draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(content), "utf-8"))
        stream.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        never_over = self.spark._sc._gateway.new_array(rename, 1)
        never_over[0] = rename.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(draft, self._path(f"{number}.json"), never_over)
        except Py4JJavaError as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise SnapshotTaken(f"{self.folder}/{number}.json") from None
            raise

    def drop(self, numbers: Iterable[int], folders: Iterable[str]) -> None:
        """Delete snapshots, then folders that no remaining one names."""
        for number in numbers:
            self._fs.delete(self._path(f"{number}.json"), False)
        for folder in folders:
            path = self._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self._conf).delete(path, True)
