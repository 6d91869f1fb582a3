"""The stored review queue: rows in fixed buckets, and a small pointer that says which files count.

Rows are hashed by their queue id, itself a hash of the finding key, into a number of buckets that never
changes. A change rewrites only the buckets that its rows fall into, in a folder of its own, and then publishes the next
version: one pointer that names a folder for each bucket. Readers follow the pointer and nothing else, so a
writer that dies half way leaves the queue as it was, and an older version stays readable until it is expired.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsreview.operators import queue
from opsreview.session import write_through
from opsreview.sources.snapshots import Snapshots, SnapshotTaken

BUCKET = "bucket"


class QueueStore:
    """A queue below ``folder``. ``buckets`` counts when the first version is written; later it is read from there. At 100 TB choose
    it so that a bucket is a few hundred MB. ``attempts``: how often a change is made anew when other writers come first."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, attempts: int = 5) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.snapshots = Snapshots(spark, self.folder)
        self.attempts = attempts
        self._buckets = buckets

    # --- Reading ------------------------------------------------------------------------

    def version(self) -> int:
        """The newest version, 0 before the first."""
        return self.snapshots.newest()

    def _pointer(self, version: int) -> dict:
        return self.snapshots.read(version) if version else {"buckets": self._buckets, "files": {}}

    def load(self, version: int | None = None) -> DataFrame:
        """A version of the queue, by default the newest."""
        version = self.version() if version is None else version
        if version and version not in self.snapshots.numbers():
            raise ValueError(f"there is no version {version}")
        return self._rows(self._pointer(version))

    def _rows(self, pointer: dict, buckets: list[int] | None = None) -> DataFrame:
        paths = [path for b, path in pointer["files"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(queue.SCHEMA).parquet(*paths) if paths else queue.empty(self.spark)

    def one(self, queue_id: str) -> DataFrame:
        """The items of one id: reads its bucket only."""
        pointer = self._pointer(self.version())
        asked = self.spark.createDataFrame([(queue_id,)], "queue_id string")
        bucket = asked.select(self._bucket(pointer)).first()[0]
        return queue.one(self._rows(pointer, [bucket]), queue_id)

    # --- Writing ------------------------------------------------------------------------

    @staticmethod
    def _bucket(pointer: dict) -> Column:
        return F.pmod(F.xxhash64("queue_id"), F.lit(pointer["buckets"])).cast("int")

    def _touched(self, rows: DataFrame, pointer: dict) -> list[int]:
        """Numbers of the buckets that some rows fall into; there are as many as buckets at most."""
        return sorted(r[0] for r in rows.select(self._bucket(pointer)).distinct().collect())

    def _write(self, rows: DataFrame, pointer: dict, touched: list[int]) -> dict:
        """Write the touched buckets to a folder of their own. Returns the pointer that would name them."""
        target = f"{self.folder}/data/{uuid.uuid4().hex}"
        placed = rows.select(*queue.SCHEMA.names).withColumn(BUCKET, self._bucket(pointer))
        placed.repartition(max(1, len(touched)), BUCKET).write.partitionBy(BUCKET).parquet(target)
        found = {str(b): f"{target}/{BUCKET}={b}" for b in touched if self._exists(f"{target}/{BUCKET}={b}")}
        kept = {b: path for b, path in pointer["files"].items() if int(b) not in touched}
        return {**pointer, "files": {**kept, **found}}

    def _exists(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _change(self, rows: DataFrame, make) -> int:
        """Make and publish a change of the buckets of ``rows``; make it anew from the newest version if another writer was first."""
        for _ in range(self.attempts):
            version = self.version()
            pointer = self._pointer(version)
            touched = self._touched(rows, pointer)
            if not touched:
                return version
            written = self._write(make(self._rows(pointer, touched)), pointer, touched)
            try:
                self.snapshots.publish(version + 1, written)
            except SnapshotTaken:
                continue
            return version + 1
        raise SnapshotTaken(f"other writers came first {self.attempts} times")

    def put(self, rows: DataFrame) -> int:
        """Replace the whole queue. Returns the version."""
        for _ in range(self.attempts):
            version = self.version()
            pointer = self._pointer(version)
            written = self._write(rows, pointer, list(range(pointer["buckets"])))
            try:
                self.snapshots.publish(version + 1, written)
            except SnapshotTaken:
                continue
            return version + 1
        raise SnapshotTaken(f"other writers came first {self.attempts} times")

    def merge(self, new_items: DataFrame, run_at: datetime | Column) -> int:
        """Merge the items of a run, as ``queue.merge`` does; items of buckets without any are not read. Returns the version."""
        items = write_through(new_items.select(*queue.ITEM), "queue-items")
        return self._change(items, lambda old: queue.merge(old, items, run_at).drop("outcome"))

    def move(self, requests: DataFrame, run_at: datetime | Column) -> DataFrame:
        """Judge move requests and apply those that pass. Returns what became of each, as ``queue.judge_moves`` does."""
        requests = write_through(requests, "queue-requests")
        judged: list[DataFrame] = []

        def moved(old: DataFrame) -> DataFrame:
            judged[:] = [write_through(queue.judge_moves(old, requests), "queue-judged")]
            return queue.apply_moves(old, judged[0], run_at)

        self._change(requests, moved)
        return judged[0] if judged else queue.judge_moves(queue.empty(self.spark), requests)

    def expire(self, keep: int = 10) -> int:
        """Delete all but the newest versions, and the folders that only those name. Returns how many went."""
        numbers = self.snapshots.numbers()
        gone, kept = numbers[:-keep], numbers[-keep:]
        used, unused = (set().union(*(self.snapshots.read(n)["files"].values() for n in some)) for some in (kept, gone))
        self.snapshots.drop(gone, sorted(unused - used))
        return len(gone)
