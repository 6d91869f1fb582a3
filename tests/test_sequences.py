import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opsreview import vocab as V
from opsreview.config import SequenceConfig
from opsreview.functions.expr import edit_distance_ratio, letters_of, similarity
from opsreview.operators import sequences as sq
from tests.world import DAY, START, keys, month, monthly_kpis, workflow, world

SHORT = {"x": "OPEN EVENT_SEARCH", "y": "OPEN VALIDATE CLOSE", "z": "CORRELATION ASSET_LOOKUP ESCALATE CLOSE"}
LETTERS = {k: letters_of(v.split()) for k, v in SHORT.items()}


def _world(spark, sequence, entity="ENT-01", severity="LOW", status="OPEN"):
    parts = [workflow(f"INV-{i:04d}", SHORT.get(s, s), started_at=START + DAY, entity_id=entity, status=status) for i, s in enumerate(sequence)]
    return world(
        spark,
        alerts=[dict(alert_id=p[0]["alert_id"], entity_id=entity, severity=severity) for p in parts],
        investigations=[p[0] for p in parts],
        investigation_actions=[a for p in parts for a in p[1]],
        performance_metrics=monthly_kpis(6, entity),
    )


def test_order_of_actions(spark):
    actions = [
        dict(action_id="ACT-4", sequence_number=2, action_type="CLOSE", occurred_at=START),
        dict(action_id="ACT-1", sequence_number=1, action_type="VALIDATE", occurred_at=START + 2 * DAY),
        dict(action_id="ACT-3", sequence_number=1, action_type="OPEN", occurred_at=START + DAY),
        dict(action_id="ACT-2", sequence_number=1, action_type="ESCALATE", occurred_at=START + DAY),
    ]
    t = world(spark, investigation_actions=actions)
    late = t.investigation_actions.withColumn("occurred_at", F.when(F.col("action_id") != "ACT-3", F.col("occurred_at")))
    row = sq.action_sequences(t.investigation_actions).first()
    assert row["letters"] == letters_of(["ESCALATE", "OPEN", "VALIDATE", "CLOSE"]) and row["has_duplicate_numbers"]
    # missing times come last among equal numbers
    row = sq.action_sequences(late.withColumn("occurred_at", F.when(F.col("action_id") == "ACT-1", F.lit(START)))).first()
    assert row["letters"] == letters_of(["VALIDATE", "ESCALATE", "OPEN", "CLOSE"])


def test_one_investigation_with_half_of_all_actions(spark):
    def rows(doubled):
        own = [dict(action_id=f"A-{k:05}", investigation_id="INV-1", sequence_number=k - (k == doubled), action_type="VALIDATE" if k % 7 else "OPEN", occurred_at=START) for k in range(2000)]
        return own + [dict(action_id=f"B-{k:05}", investigation_id=f"INV-{2 + k}", sequence_number=1, action_type="CLOSE", occurred_at=START) for k in range(2000)]

    for doubled in (-1, 1234):
        built = sq.action_sequences(world(spark, investigation_actions=rows(doubled)).investigation_actions)
        row = built.where("investigation_id = 'INV-1'").first()
        assert row["letters"] == letters_of(["VALIDATE" if k % 7 else "OPEN" for k in range(2000)])
        assert row["action_count"] == 2000 and row["has_duplicate_numbers"] == (doubled > 0)
    plan = built._jdf.queryExecution().toString()
    assert "approx_top_k" not in plan and "isin" not in plan


def test_short_investigations_are_read_off_and_long_ones_put_together(spark, monkeypatch):
    rng = random.Random(5)
    kinds = sorted(V.ACTION_TYPES)
    rows = [
        dict(action_id=f"A-{i:04}", investigation_id=None if rng.random() < 0.1 else f"INV-{rng.randrange(12)}", action_type=rng.choice(kinds),
             sequence_number=rng.choice([None, *range(40)]), occurred_at=rng.choice([None, START, START + DAY]))
        for i in range(300)
    ]
    actions = world(spark, investigation_actions=rows).investigation_actions

    def built():
        return {r["investigation_id"]: tuple(r) for r in sq.action_sequences(actions).collect()}

    with monkeypatch.context() as m:
        m.setattr(sq, "_from_pieces", lambda steps: pytest.fail("nothing is long"))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        short = built()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r[2] for r in short.values()) == 300 and len(short) == len({r["investigation_id"] for r in rows})
    for i, row in short.items():
        own = [r for r in rows if r["investigation_id"] == i]
        own.sort(key=lambda r: (-1 if r["sequence_number"] is None else r["sequence_number"], r["occurred_at"] is None, r["occurred_at"] or START, r["action_id"]))
        numbers = [r["sequence_number"] for r in own]
        assert row[1:] == (letters_of([r["action_type"] for r in own]), len(own), len(set(numbers)) < len(numbers))
    monkeypatch.setattr(sq, "LONG", 22)
    assert built() == short
    monkeypatch.setattr(sq, "LONG", 0)
    assert built() == short


def test_action_ids_are_moved_only_where_others_meet_at_one_moment(spark, monkeypatch):
    sorted_columns, real = [], sq._sorted
    monkeypatch.setattr(sq, "_sorted", lambda steps: sorted_columns.append(steps.columns) or real(steps))

    def built(*kinds):
        rows = [dict(action_id=f"A-{9 - i}", investigation_id="INV-1", sequence_number=1, action_type=k, occurred_at=START) for i, k in enumerate(kinds)]
        rows += [dict(action_id=f"B-{i}", investigation_id="INV-2", sequence_number=1, action_type=k, occurred_at=START + i * DAY) for i, k in enumerate(("OPEN", "CLOSE"))]
        sorted_columns.clear()
        return {r["investigation_id"]: r["letters"] for r in sq.action_sequences(world(spark, investigation_actions=rows).investigation_actions).collect()}

    plain = letters_of(["OPEN", "CLOSE"])
    assert built("CLOSE", "CLOSE") == {"INV-1": letters_of(["CLOSE", "CLOSE"]), "INV-2": plain}
    assert len(sorted_columns) == 1 and "id" not in sorted_columns[0]
    for kinds in (("CLOSE", "OPEN"), ("OPEN", "CLOSE")):
        assert built(*kinds) == {"INV-1": letters_of(kinds[::-1]), "INV-2": plain}
        assert len(sorted_columns) == 2 and "id" in sorted_columns[1]


def test_long_investigations_are_found_in_full_buckets(spark, monkeypatch):
    monkeypatch.setattr(sq, "LONG", 3)
    monkeypatch.setattr(sq, "BUCKETS", 2)
    ids = [(f"INV-{i}",) for i in range(20)] + [("INV-3",)] * 3 + [(None,)] * 4
    found = sq._long_ids(spark.createDataFrame(ids, "investigation_id string"))
    assert {r[0] for r in found.collect()} == {"INV-3", None}
    monkeypatch.setattr(sq, "LONG", 100)
    assert sq._long_ids(spark.createDataFrame(ids, "investigation_id string")).isEmpty()


def test_unknown_action_stops(spark):
    t = world(spark, investigation_actions=[dict(action_type="COFFEE")])
    with pytest.raises(Exception, match="COFFEE"):
        sq.action_sequences(t.investigation_actions).collect()


def test_distance(spark):
    df = spark.createDataFrame([("", ""), ("abc", "abd"), ("", "ab"), ("abcd", "dcba")], "a string, b string")
    got = [tuple(r) for r in df.select(edit_distance_ratio("a", "b"), similarity("a", "b")).collect()]
    assert got == [(0.0, 1.0), (pytest.approx(1 / 3), pytest.approx(2 / 3)), (1.0, 0.0), (1.0, 0.0)]


def test_running_baseline_with_ties(spark):
    records = sq.investigation_records(_world(spark, "xyyxzxx"))
    config = SequenceConfig(min_baseline_investigations=1)
    rows = sq.running_baseline(records, config).orderBy("investigation_id").collect()
    assert [r["baseline_letters"] for r in rows] == [LETTERS[c] for c in "xxyxxx"]
    assert [r["baseline_investigation_count"] for r in rows] == [1, 1, 2, 2, 2, 3]


def test_running_baseline_against_brute_force(spark):
    """One entity spread over many blocks, another small one, random ties."""
    rng = random.Random(11)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = []
        for i in range(400):
            entity = "ENT-01" if rng.random() < 0.8 else "ENT-02"
            rows.append((f"INV-{i:04d}", entity, month(rng.randrange(4)), "".join(rng.choice("ab") for _ in range(rng.randrange(1, 5)))))
        schema = "investigation_id string, entity_id string, period_start timestamp, letters string"
        df = spark.createDataFrame(rows, schema).withColumn("action_count", F.length("letters")).withColumn("period_end", F.col("period_start"))
        records = sq.in_blocks(df, ["entity_id"], ["period_start", "investigation_id"], "t")
        assert records.select("block").distinct().count() > 8
        got = {r["investigation_id"]: (r["baseline_letters"], r["baseline_investigation_count"], r["n_prior"]) for r in sq.running_baseline(records).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    expected = {}
    for entity in ("ENT-01", "ENT-02"):
        seen: Counter = Counter()
        for inv, _, _, letters in sorted((r for r in rows if r[1] == entity and len(r[3]) >= 2), key=lambda r: (r[2], r[0])):
            if seen.total() >= 3:
                expected[inv] = (*seen.most_common(1)[0], seen.total())
            seen[letters] += 1
    assert got == expected and len(got) > 200


def test_deviation_threshold_and_confidence(spark):
    five, four_off = "OPEN OPEN OPEN OPEN OPEN", "OPEN OPEN CLOSE CLOSE CLOSE"  # distance exactly 0.6
    records = sq.investigation_records(_world(spark, [five] * 3 + [four_off]))
    row = sq.deviating(records).collect()
    assert [r["finding_key"] for r in row] == ["IF-DEV-002:INV-0003"]
    assert row[0]["normalized_distance"] == 0.6 and row[0]["confidence"] == "MODERATE"
    near = sq.investigation_records(_world(spark, [five] * 3 + ["OPEN OPEN OPEN CLOSE CLOSE"]))
    assert sq.deviating(near).count() == 0
    far = sq.investigation_records(_world(spark, [five] * 6 + ["CLOSE CLOSE"]))
    assert sq.deviating(far).first()["confidence"] == "HIGH"
    few = sq.investigation_records(_world(spark, [five] * 2 + [four_off]))
    assert sq.deviating(few).count() == 0


def test_repetition(spark):
    found = sq.repetitive(sq.investigation_records(_world(spark, "yxyxyzOPEN".replace("OPEN", "")))).collect()
    assert len(found) == 1 and found[0]["matching_investigation_count"] == 3
    assert found[0]["repetition_rate"] == 0.5 and found[0]["confidence"] == "MODERATE"
    assert found[0]["dominant_sequence"] == SHORT["y"].split()
    assert sq.repetitive(sq.investigation_records(_world(spark, "xxyyz"))).count() == 0
    tie = sq.repetitive(sq.investigation_records(_world(spark, "yxxyxy"))).first()
    assert tie["letters"] == LETTERS["y"]  # seen first
    high = sq.repetitive(sq.investigation_records(_world(spark, "xxxxxx"))).first()
    assert high["confidence"] == "HIGH"
    short = sq.repetitive(sq.investigation_records(_world(spark, ["OPEN"] * 5)))
    assert short.count() == 0  # one action is too short to compare
    members = sq.repetition_members(sq.investigation_records(_world(spark, "yxyxyz")), sq.repetitive(sq.investigation_records(_world(spark, "yxyxyz"))))
    assert sorted(r["investigation_id"] for r in members.collect()) == ["INV-0000", "INV-0002", "INV-0004"]


def test_missing_action(spark):
    def found(actions, severity="HIGH", status="CLOSED"):
        return sq.incomplete(sq.investigation_records(_world(spark, [actions], severity=severity, status=status)))

    assert keys(found("OPEN CLOSE")) == ["IF-MEA-003:INV-0000"]
    assert found("OPEN VALIDATE CLOSE").count() == 0 and found("EVIDENCE_REVIEW").count() == 0
    assert found("OPEN CLOSE", severity="MEDIUM").count() == 0
    assert found("OPEN CLOSE", status="IN_PROGRESS").count() == 0
    assert found("").first()["confidence"] == "LOW" and found("").first()["observed_sequence"] == []
    assert found("OPEN OPEN CLOSE").first()["confidence"] == "MODERATE"
    assert found("OPEN OPEN OPEN OPEN OPEN CLOSE").first()["confidence"] == "HIGH"
    assert found("OPEN").first()["missing_action_types"] == ["EVIDENCE_REVIEW", "VALIDATE"]


def test_outside_every_period_is_left_out(spark):
    t = _world(spark, ["OPEN CLOSE"], severity="HIGH", status="CLOSED")
    moved = t.investigations.withColumn("started_at", F.lit(month(6)))
    t = t.replace(investigations=moved)
    assert sq.investigation_records(t).count() == 0


@pytest.mark.parametrize(
    "bad",
    [
        dict(min_sequence_length=0), dict(min_comparable_investigations=1), dict(repetition_threshold=1),
        dict(repetition_rate_threshold=0), dict(deviation_threshold=1.1), dict(min_baseline_investigations=0),
        dict(missing_action_min_severity="LOW"), dict(expected_actions=()),
    ],
)
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        SequenceConfig(**bad)
