"""The stored queue: versions by pointer, buckets, moves, writers that die."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from opsreview.functions.expr import short_hash
from opsreview.operators import queue
from opsreview.sources.queue_store import QueueStore
from opsreview.sources.snapshots import SnapshotTaken

T1, T2 = datetime(2024, 7, 1), datetime(2024, 7, 2)


def items(spark, *numbers, version="v1"):
    rows = spark.createDataFrame([(f"key-{n}",) for n in numbers], "finding_key string")
    texts = {c: F.lit(c) for c in queue.ITEM if c not in ("queue_id", "finding_key", "evidence_count", "finding_version")}
    return rows.select(
        short_hash(F.col("finding_key"), 12).alias("queue_id"), "finding_key", *[v.alias(c) for c, v in texts.items()],
        F.lit(1).cast("long").alias("evidence_count"), F.lit(version).alias("finding_version"),
    )


def state(df):
    return sorted((r["finding_key"], r["status"], r["finding_version"], r["updated_at"]) for r in df.collect())


def test_merges_equal_the_plain_merge_and_touch_few_buckets(spark, tmp_path):
    store = QueueStore(spark, str(tmp_path / "q"), buckets=16)
    first, second = items(spark, *range(60)), items(spark, 3, 7, 100, version="v2")
    assert store.merge(first, T1) == 1 and store.merge(second, T2) == 2
    plain = queue.merge(queue.merge(queue.empty(spark), first, T1), second, T2)
    assert state(store.load()) == state(plain) and store.load(1).count() == 60
    before, after = (store.snapshots.read(n)["files"] for n in (1, 2))
    changed = [b for b in after if before.get(b) != after[b]]
    assert 1 <= len(changed) <= 3 and store.merge(items(spark).limit(0), T2) == 2
    assert QueueStore(spark, str(tmp_path / "q"), buckets=3).merge(items(spark, 5, version="v3"), T2) == 3  # buckets stay 16
    assert store.load().where("finding_version = 'v3'").count() == 1 and store.load().count() == 61


def test_a_write_that_dies_between_buckets_leaves_the_older_version(spark, tmp_path):
    store = QueueStore(spark, str(tmp_path / "q"), buckets=4)
    store.merge(items(spark, *range(20)), T1)
    before = state(store.load())
    # One of the buckets fails while others are written.
    poison = F.when(F.col("finding_key") == "key-7", F.raise_error(F.lit("disk lost"))).otherwise(F.col("title"))
    with pytest.raises(Exception, match="disk lost"):
        store._change(items(spark, *range(20)), lambda old: old.withColumn("title", poison.cast("string")))
    assert store.version() == 1 and state(store.load()) == before
    assert store.merge(items(spark, *range(20), version="v2"), T2) == 2


def test_a_write_that_dies_before_its_pointer(spark, tmp_path, monkeypatch):
    store = QueueStore(spark, str(tmp_path / "q"), buckets=4)
    store.merge(items(spark, 1, 2), T1)

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched, pytest.raises(KeyboardInterrupt):
        patched.setattr(store.snapshots, "publish", die)
        store.merge(items(spark, 1, 3, version="v2"), T2)
    assert store.load().count() == 2 and store.load().where("finding_version = 'v2'").count() == 0


def test_two_writers(spark, tmp_path, monkeypatch):
    """The writer that comes second makes its change again on top of the first."""
    store, other = (QueueStore(spark, str(tmp_path / "q"), buckets=2) for _ in range(2))
    publish, done = store.snapshots.publish, []

    def slow(number, content):
        if not done:
            done.append(other.merge(items(spark, 2), T1))
        publish(number, content)

    monkeypatch.setattr(store.snapshots, "publish", slow)
    assert store.merge(items(spark, 1), T1) == 2 and sorted(r[0] for r in state(other.load())) == ["key-1", "key-2"]
    monkeypatch.setattr(store.snapshots, "publish", lambda number, content: (_ for _ in ()).throw(SnapshotTaken("always")))
    with pytest.raises(SnapshotTaken):
        store.merge(items(spark, 3), T1)


def test_moves(spark, tmp_path):
    store = QueueStore(spark, str(tmp_path / "q"), buckets=4)
    store.merge(items(spark, *range(6)), T1)
    ids = {r["finding_key"]: r["queue_id"] for r in store.load().collect()}
    asked = [(ids["key-1"], "DISMISSED", "ann", "no", 1), (ids["key-1"], "OPEN", "ann", None, 2), (ids["key-2"], "OPEN", "ann", None, 3), ("nowhere", "REVIEWED", None, None, 4)]
    requests = spark.createDataFrame(asked, "queue_id string, new_status string, reviewer_ref string, review_note string, request_no long")
    results = {r["request_no"]: r["result"] for r in store.move(requests, T2).collect()}
    assert results == {1: "APPLIED", 2: "NOT_FIRST", 3: "INVALID_TRANSITION", 4: "NOT_FOUND"}
    assert store.one(ids["key-1"]).select("status", "reviewer_ref").collect() == [("DISMISSED", "ann")]
    assert store.load(1).where("status <> 'OPEN'").count() == 0 and store.one("nowhere").count() == 0
    assert store.move(requests.limit(0), T2).count() == 0 and store.version() == 2


def test_an_id_that_two_findings_share_moves_neither(spark, tmp_path):
    store = QueueStore(spark, str(tmp_path / "q"), buckets=2)
    store.merge(items(spark, 1, 2).withColumn("queue_id", F.lit("same")), T1)
    requests = spark.createDataFrame([("same", "DISMISSED", "ann", None, 1)], "queue_id string, new_status string, reviewer_ref string, review_note string, request_no long")
    assert store.move(requests, T2).first()["result"] == "AMBIGUOUS"
    assert {r["status"] for r in store.load().collect()} == {"OPEN"}


def test_old_versions_expire(spark, tmp_path):
    store = QueueStore(spark, str(tmp_path / "q"), buckets=2)
    for n in range(4):
        store.merge(items(spark, n), T1)
    assert store.expire(keep=2) == 2 and store.snapshots.numbers() == [3, 4]
    assert store.load().count() == 4 and store.load(3).count() == 3
    with pytest.raises(ValueError):
        store.load(1)


def test_whole_states_count_once_their_pointer_is_there(spark, tmp_path):
    folder = str(tmp_path / "v")
    rows = queue.merge(queue.empty(spark), items(spark, 1), T1)
    queue.save(rows, folder, 1)
    rows.drop("outcome").write.parquet(f"{folder}/version=2")  # its writer died before the pointer
    assert queue.load(spark, folder).count() == 1
    with pytest.raises(ValueError):
        queue.load(spark, folder, 2)
