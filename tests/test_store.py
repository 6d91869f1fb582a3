"""Snapshots, transactions, key filters and upkeep of stored datasets."""

import json

import pytest
from pyspark.sql import functions as F

from opsreview.operators import keyfilter, validate
from opsreview.schemas import DATASETS
from opsreview.sources.files import read_batch
from opsreview.sources.snapshots import Snapshots, SnapshotTaken
from opsreview.sources.store import Store
from tests.test_ingest import ENTITY, _csv

ASSET = dict(asset_id="AST-1", entity_id="ENT-01", name="a", category="SERVER", criticality="LOW", monitoring_expected="t", created_at="2024-01-01T00:00:00Z")


def entities(tmp_path, name, *numbers):
    return _csv(tmp_path / f"{name}.csv", [dict(ENTITY, entity_id=f"ENT-{n:02}") for n in numbers])


def stored(store, dataset="entities"):
    return sorted(r[0] for r in store.table(dataset).select(DATASETS[dataset].key).collect())


def test_a_number_is_published_once(spark, tmp_path):
    snapshots = Snapshots(spark, str(tmp_path / "s"))
    assert (snapshots.newest(), snapshots.numbers()) == (0, [])
    snapshots.publish(1, {"a": 1})
    with pytest.raises(SnapshotTaken):
        snapshots.publish(1, {"a": 2})
    snapshots.publish(2, {"a": 3})
    assert snapshots.numbers() == [1, 2] and snapshots.read(1) == {"a": 1} and snapshots.read(snapshots.newest()) == {"a": 3}


def test_two_writers_of_the_same_key(spark, tmp_path, monkeypatch):
    """The second writer's import was checked before the first one's came in; it is checked again."""
    first, second = Store(spark, str(tmp_path / "st")), Store(spark, str(tmp_path / "st"))
    path, publish = entities(tmp_path, "e", 1), second._publish
    calls = []

    def slow(number, staged, rows):
        if not calls:
            calls.append(first.load("entities", path)[0])
        publish(number, staged, rows)

    monkeypatch.setattr(second, "_publish", slow)
    assert second.load("entities", path)[0] == "REJECTED" and calls == ["COMPLETED"]
    assert stored(second) == ["ENT-01"] and sorted(r["status"] for r in first.log().collect()) == ["COMPLETED", "REJECTED"]


def test_independent_writers_both_get_in(spark, tmp_path, monkeypatch):
    first, second = Store(spark, str(tmp_path / "st")), Store(spark, str(tmp_path / "st"))
    publish, other, done = second._publish, entities(tmp_path, "b", 2), []

    def slow(number, staged, rows):
        if not done:
            done.append(first.load("entities", other)[0])
        publish(number, staged, rows)

    monkeypatch.setattr(second, "_publish", slow)
    assert second.load("entities", entities(tmp_path, "a", 1))[0] == "COMPLETED"
    assert stored(first) == ["ENT-01", "ENT-02"]


def test_a_writer_that_always_comes_second_gives_up(spark, tmp_path, monkeypatch):
    first, second = Store(spark, str(tmp_path / "st")), Store(spark, str(tmp_path / "st"), attempts=2)
    publish, done = second._publish, []

    def slow(number, staged, rows):
        if len(done) < 2:
            done.append(first.load("entities", entities(tmp_path, f"o{len(done)}", 50 + len(done)))[0])
        publish(number, staged, rows)

    monkeypatch.setattr(second, "_publish", slow)
    assert second.load("entities", entities(tmp_path, "a", 1), import_id="IMP-late")[0] == "ROLLED_BACK"
    assert stored(first) == ["ENT-50", "ENT-51"] and first.import_of("IMP-late").first()["status"] == "ROLLED_BACK"


def test_several_datasets_appear_together_or_not_at_all(spark, tmp_path):
    store = Store(spark, str(tmp_path / "st"))
    good, bad = _csv(tmp_path / "a.csv", [ASSET]), _csv(tmp_path / "b.csv", [dict(ASSET, entity_id="ENT-77")])
    people = entities(tmp_path, "e", 1)
    assert store.load_all({"assets": bad, "entities": people}) == {"entities": "ROLLED_BACK", "assets": "REJECTED"}
    assert stored(store) == [] and stored(store, "assets") == [] and store.log().count() == 2
    assert store.load_all({"assets": good, "entities": people}) == {"entities": "COMPLETED", "assets": "COMPLETED"}
    assert store.snapshots.newest() == 2
    other = {"entities": entities(tmp_path, "f", 2), "assets": _csv(tmp_path / "c.csv", [dict(ASSET, asset_id="AST-2", entity_id="ENT-02")])}
    assert store.load_all(other, mode="REPLACE") == {"entities": "COMPLETED", "assets": "COMPLETED"}  # parent and child at once
    assert stored(store) == ["ENT-02"] and stored(store, "assets") == ["AST-2"]
    assert store.load_all({"planets": people})["planets"] == "REJECTED"


def test_a_writer_that_dies_before_publishing_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "st"))
    store.load("entities", entities(tmp_path, "a", 1))

    def die(*_):
        raise KeyboardInterrupt

    broken = Store(spark, str(tmp_path / "st"))
    monkeypatch.setattr(broken.snapshots, "publish", die)
    with pytest.raises(KeyboardInterrupt):
        broken.load("entities", entities(tmp_path, "b", 2))
    assert stored(store) == ["ENT-01"] and store.log().count() == 1
    assert store.load("entities", entities(tmp_path, "c", 2))[0] == "COMPLETED"


def test_small_parts_are_joined_and_old_snapshots_expire(spark, tmp_path):
    store = Store(spark, str(tmp_path / "st"), most_parts=3)
    for n in range(1, 8):
        assert store.load("entities", entities(tmp_path, f"e{n}", n))[0] == "COMPLETED"
    state = store.state()
    assert stored(store) == [f"ENT-{n:02}" for n in range(1, 8)] and len(state.parts("entities")) <= 3
    assert len(state.manifest["imports"]) <= 3 and store.log().count() == 7
    assert store.load("entities", entities(tmp_path, "again", 3))[0] == "REJECTED"  # filters of joined parts hold the keys
    early = store.state(2)
    assert early.table("entities").count() == 2
    folders = Store._folders(early.manifest)
    assert store.expire(keep=1) > 0 and store.snapshots.numbers() == [store.snapshots.newest()]
    assert stored(store) == [f"ENT-{n:02}" for n in range(1, 8)]
    left = [f for f in folders if spark._jvm.java.io.File(f).exists()]
    assert all(f in Store._folders(store.state().manifest) for f in left)


@pytest.mark.parametrize("bits", [0.001, 12.0])
def test_false_positives_change_nothing(spark, tmp_path, bits):
    """A filter of one block takes nearly all values for hits; a usual one hardly any."""
    keys = spark.range(0, 4_000).select(F.concat(F.lit("AST-"), F.col("id").cast("string")).alias("asset_id"))
    rows = [dict(ASSET, asset_id=f"AST-{n}", entity_id=f"ENT-{n % 30:02}") for n in [*range(3_990, 4_200), 17, 17]]
    people = spark.range(0, 20).select(F.format_string("ENT-%02d", "id").alias("entity_id"))
    filters = {}
    for (name, column), df in {("assets", "asset_id"): keys, ("entities", "entity_id"): people}.items():
        blocks = keyfilter.blocks_for(df.count(), bits)
        filters[name, column] = keyfilter.KeyFilter(keyfilter.build(df, column, blocks), (blocks,))
    batch = read_batch(spark, "assets", _csv(tmp_path / "a.csv", rows))
    plain, probed = (validate.validate(spark, batch, {"entities": people}, keys, filters=f) for f in (None, filters))

    def found(v):
        return sorted((r["row"], r["field"], r["code"]) for r in v.issues.collect())

    assert found(plain) == found(probed) and plain.error_count == 10 + 2 + 1 + sum(int(r["entity_id"][4:]) >= 20 for r in rows)
    asked = spark.range(4_000, 8_000).select(F.concat(F.lit("AST-"), F.col("id").cast("string")).alias("asset_id"))
    hits = keyfilter.hits(asked, "asset_id", filters["assets", "asset_id"]).count()
    assert hits > 3_000 if bits < 1 else hits < 100
    assert keyfilter.hits(keys, "asset_id", filters["assets", "asset_id"]).count() == 4_000


def test_filters_of_several_sizes_are_laid_together(spark):
    parts = [spark.range(a, b).select(F.col("id").cast("string").alias("k")) for a, b in ((0, 10), (10, 3_000))]
    built = [keyfilter.build(p, "k", n) for p, n in zip(parts, (1, 128), strict=True)]
    keys = keyfilter.KeyFilter(built[0].unionByName(built[1]), (1, 128))
    asked = spark.range(0, 3_000).select(F.col("id").cast("string").alias("k")).unionByName(spark.createDataFrame([(None,)], "k string"))
    assert keyfilter.hits(asked, "k", keys).count() == 3_000


def test_manifests_name_folders_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "st"))
    store.load("entities", entities(tmp_path, "a", *range(1, 40)))
    assert len(json.dumps(store.state().manifest)) < 2_000
