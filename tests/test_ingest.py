import csv
import json
from datetime import datetime, timezone

import pytest

from opsreview import vocab as V
from opsreview.operators import audit, validate
from opsreview.schemas import DATASETS
from opsreview.sources.files import export, read_batch
from opsreview.sources.store import Store, dataset_types
from tests.world import DAY, START, workflow, world

ENTITY = dict(
    entity_id="ENT-01", name="One", sector="finance", peer_group="A", scale="Small", asset_count_estimate="5.0",
    analyst_headcount="1e1", created_at="2024-01-01T00:00:00Z", data_period_start="2024-01-01 00:00:00+00:00",
    data_period_end="2024-07-01T02:00:00.000+02:00",
)


def _csv(path, rows, columns=None):
    columns = columns or list(rows[0])
    lines = [",".join(columns)] + [",".join("" if r.get(c) is None else str(r[c]) for c in columns) for r in rows]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def _codes(checked):
    found = [(r["row"], r["field"], r["code"]) for r in checked.issues.collect()]
    return sorted(found, key=lambda x: (x[0] or 0, x[1] or "", x[2]))


def _check(spark, name, path, **more):
    return validate.validate(spark, read_batch(spark, name, path), **more)


def test_good_csv_is_typed(spark, tmp_path):
    checked = _check(spark, "entities", _csv(tmp_path / "e.csv", [ENTITY]))
    assert checked.is_valid and (checked.row_count, checked.accepted_count) == (1, 1)
    row = checked.accepted.first()
    assert (row["sector"], row["scale"], row["asset_count_estimate"], row["analyst_headcount"]) == ("FINANCE", "SMALL", 5, 10)
    same = checked.accepted.where("data_period_end = timestamp'2024-07-01 00:00:00 UTC'").count()
    assert same == 1 and checked.accepted.schema.fieldNames() == DATASETS["entities"].struct.fieldNames()


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    rows = [dict(ENTITY, entity_id=f"ENT-{i}", sector="FINANCE" if i != 17 else "MINING") for i in range(1, 40)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        checked = _check(spark, "entities", _csv(tmp_path / "e.csv", rows))
        assert _codes(checked) == [(17, "sector", "invalid_enum_value")] and checked.rejected_count == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(
    "changes, code",
    [
        (dict(entity_id=""), "missing_required_value"),
        (dict(entity_id="ENT-x"), "invalid_identifier_format"),
        (dict(sector="MINING"), "invalid_enum_value"),
        (dict(asset_count_estimate="2.5"), "invalid_field_type"),
        (dict(asset_count_estimate="true"), "invalid_field_type"),
        (dict(asset_count_estimate="nan"), "invalid_field_type"),
        (dict(asset_count_estimate="-1"), "negative_value"),
        (dict(created_at="2024-01-01"), "naive_timestamp"),
        (dict(created_at="2024-13-01T00:00:00Z"), "invalid_timestamp"),
        (dict(created_at="soon"), "invalid_timestamp"),
        (dict(data_period_end="2023-01-01T00:00:00Z"), "temporal_order"),
    ],
)
def test_cell_problems(spark, tmp_path, changes, code):
    checked = _check(spark, "entities", _csv(tmp_path / "e.csv", [dict(ENTITY, **changes)]))
    assert [c for _, _, c in _codes(checked)] == [code] and not checked.is_valid and checked.accepted.count() == 0
    structural = code in V.STRUCTURAL_CODES
    assert (checked.structural_count, checked.semantic_count) == ((1, 0) if structural else (0, 1))


def test_naive_times_can_be_allowed(spark, tmp_path):
    path = _csv(tmp_path / "e.csv", [dict(ENTITY, created_at="2024-01-01 12:30", data_period_start="2023-12-31")])
    assert _check(spark, "entities", path, assume_utc=True).is_valid


def test_a_time_stamp_is_parsed_once_however_many_problems_look_at_it(spark):
    names = [f.name for f in DATASETS["alerts"].fields]
    rows = spark.createDataFrame([tuple([1, *("x" for _ in names)])], f"_row bigint, {', '.join(f'{n} string' for n in names)}")
    plan = validate.check_cells(rows, DATASETS["alerts"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[0-9]{4}-[0-9]{2}") == 2  # does it fit, and which are its parts


def test_odd_time_stamps(spark):
    good = datetime(2024, 1, 1, 10, 0)
    spelled = [
        ("2024-01-01T10:00:00Z", good, None), ("2024-01-01 12:00+0200", good, None), ("2024-01-01T05:00:00,000-05", good, None),
        ("2024-01-01T10:00z", good, None), ("2024-01-01T10:00", None, "naive_timestamp"), ("2024-01-01T10:00:00Z|", None, "invalid_timestamp"),
        ("2024|10:00||||Z", None, "invalid_timestamp"), ("2024-01-01T10:00:00Z\u2028", good, None), ("|||||", None, "invalid_timestamp"), (None, None, None),
    ]
    rows = spark.createDataFrame([(i, text) for i, (text, _, _) in enumerate(spelled)], "_row bigint, acknowledged_at string")
    found = validate.check_cells(rows, DATASETS["alerts"]).selectExpr(
        "_row", "date_format(acknowledged_at, 'yyyy-MM-dd HH:mm') AS at", "filter(_issues, i -> i.field = 'acknowledged_at') AS issues"
    ).orderBy("_row").collect()
    assert [r["at"] for r in found] == [at and f"{at:%Y-%m-%d %H:%M}" for _, at, _ in spelled]
    assert [[i["code"] for i in r["issues"]] for r in found] == [[code] if code else [] for _, _, code in spelled]


def test_range_and_boolean(spark, tmp_path):
    kpi = dict(metric_id="PMET-1", entity_id="ENT-01", period_start="2024-01-01T00:00:00Z", period_end="2024-01-01T00:00:00Z", mttr_hours="0",
               closure_rate="1.0", sla_compliance="1.01", escalation_rate="-0.1", investigation_completeness="inf", recurrence_rate=".5",
               remediation_rate="1", evidence_completeness="0")
    assert _codes(_check(spark, "performance_metrics", _csv(tmp_path / "k.csv", [kpi]))) == [
        (1, "escalation_rate", "negative_value"), (1, "investigation_completeness", "invalid_field_type"), (1, "sla_compliance", "value_out_of_range"),
    ]
    words = [("Yes", None), ("0", None), ("maybe", "invalid_field_type"), ("", "missing_required_value")]
    assets = [dict(asset_id=f"AST-{i}", entity_id="ENT-01", name="a", category="SERVER", criticality="LOW", monitoring_expected=w, created_at="2024-01-01T00:00:00Z") for i, (w, _) in enumerate(words)]
    assert [c for _, _, c in _codes(_check(spark, "assets", _csv(tmp_path / "a.csv", assets)))] == ["invalid_field_type", "missing_required_value"]


@pytest.mark.parametrize(
    "name, content, code",
    [
        ("x.txt", "a", "unsupported_format"),
        ("x.csv", "", "empty_dataset"),
        ("x.csv", '[{"a": 1}]', "content_format_mismatch"),
        ("x.csv", "entity_id,name\nENT-1,a,b\n", "malformed_csv"),
        ("x.json", "[1", "malformed_json"),
        ("x.json", '{"rows": []}', "invalid_json_structure"),
        ("x.json", "[1]", "invalid_json_structure"),
        ("x.json", "[]", "empty_dataset"),
        ("x.jsonl", '{"a": 1}\n{"a"\n', "malformed_json"),
    ],
)
def test_file_problems(spark, tmp_path, name, content, code):
    path = tmp_path / name
    path.write_text(content)
    checked = _check(spark, "entities", str(path))
    assert code in [c for _, _, c in _codes(checked)] and checked.structural_count == checked.error_count > 0


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"entity_id\n\xff\xfe\n")
    assert _codes(_check(spark, "entities", str(tmp_path / "x.csv"))) == [(None, None, "content_format_mismatch")]
    assert _codes(_check(spark, "planets", str(tmp_path / "x.csv"))) == [(None, None, "unsupported_dataset_type")]


def test_csv_records_over_several_lines(spark, tmp_path):
    rows = [dict(ENTITY, name='a "quoted"\nname'), dict(ENTITY, entity_id="ENT-02", name="plain")]
    with open(tmp_path / "e.csv", "w", newline="") as f:
        out = csv.DictWriter(f, list(ENTITY), lineterminator="\n")
        out.writeheader()
        out.writerows(rows)
    checked = _check(spark, "entities", str(tmp_path / "e.csv"))
    assert _codes(checked) == [] and checked.row_count == 2
    assert [r["name"] for r in checked.accepted.orderBy("entity_id").collect()] == ['a "quoted"\nname', "plain"]
    (tmp_path / "open.csv").write_text((tmp_path / "e.csv").read_text() + '"ENT-03,never\nclosed,x\nENT-04,y\n')
    assert _codes(_check(spark, "entities", str(tmp_path / "open.csv"))) == [(None, None, "malformed_csv")]


def test_of_a_repeated_header_name_the_first_column_counts(spark, tmp_path):
    text = open(_csv(tmp_path / "e.csv", [ENTITY])).read().splitlines()
    (tmp_path / "twice.csv").write_text(f"{text[0]},entity_id\n{text[1]},ENT-99\n")
    checked = _check(spark, "entities", str(tmp_path / "twice.csv"))
    assert _codes(checked) == [] and [r["entity_id"] for r in checked.accepted.collect()] == [ENTITY["entity_id"]]


def test_columns(spark, tmp_path):
    row = {k: v for k, v in ENTITY.items() if k != "scale"}
    checked = _check(spark, "entities", _csv(tmp_path / "e.csv", [dict(row, colour="red")]))
    assert _codes(checked) == [(None, "colour", "unknown_column"), (None, "scale", "missing_required_column")]


def test_json_forms_are_equal(spark, tmp_path):
    row = dict(ENTITY, asset_count_estimate=5, analyst_headcount=10)
    (tmp_path / "a.json").write_text(json.dumps([row, dict(row, entity_id="ENT-02", name=None)]))
    (tmp_path / "b.json").write_text(json.dumps({"records": [row, dict(row, entity_id="ENT-02", name=" ")]}))
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(r) for r in [row, dict(row, entity_id="ENT-02", name="", extra=None)]) + "\n")
    for name in ("a.json", "b.json"):
        checked = _check(spark, "entities", str(tmp_path / name))
        assert _codes(checked) == [(2, "name", "missing_required_value")] and checked.accepted_count == 1
    assert _codes(_check(spark, "entities", str(tmp_path / "c.jsonl"))) == [(None, "extra", "unknown_column")]


def test_duplicates_and_references(spark, tmp_path):
    base = dict(analyst_id="ANALYST-1", status="OPEN", started_at="2024-01-01T00:00:00Z", evidence_count="0", entity_id="ENT-01")
    rows = [dict(base, investigation_id=f"INV-{i}", alert_id=f"ALR-{a}") for i, a in ((1, 1), (1, 2), (1, 2), (2, 3), (9, 4))]
    rows[4]["entity_id"] = "ENT-77"
    known = {
        "alerts": spark.createDataFrame([(f"ALR-{i}",) for i in (1, 2, 4)], "alert_id string"),
        "entities": spark.createDataFrame([("ENT-01",)], "entity_id string"),
    }
    stored = spark.createDataFrame([("INV-9", "ALR-1")], "investigation_id string, alert_id string")
    path = _csv(tmp_path / "i.csv", rows)
    in_batch = [(2, "investigation_id", "duplicate_identifier"), (3, "alert_id", "duplicate_unique_value"), (3, "investigation_id", "duplicate_identifier")]
    missing = [(4, "alert_id", "missing_reference"), (5, "entity_id", "missing_reference")]
    against = [(1, "alert_id", "duplicate_unique_value"), (5, "investigation_id", "duplicate_identifier")]
    assert _codes(_check(spark, "investigations", path)) == in_batch
    assert _codes(_check(spark, "investigations", path, references=known, existing=stored)) == sorted(in_batch + missing + against)
    replaced = _check(spark, "investigations", path, references=known, existing=stored, mode="REPLACE")
    assert _codes(replaced) == sorted(in_batch + missing)
    assert replaced.detail(2).count() == 2 and replaced.error_count == 5 and replaced.rejected_count == 4


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    entities = _csv(tmp_path / "e.csv", [ENTITY, dict(ENTITY, entity_id="ENT-02")])
    asset = dict(asset_id="AST-1", entity_id="ENT-02", name="a", category="SERVER", criticality="LOW", monitoring_expected="t", created_at="2024-01-01T00:00:00Z")
    assets = _csv(tmp_path / "a.csv", [asset])
    when = datetime(2024, 5, 1, tzinfo=timezone.utc)
    assert store.load("assets", assets)[0] == "REJECTED"  # its entity is not stored yet
    assert store.load_all({"assets": assets, "entities": entities}) == {"entities": "COMPLETED", "assets": "COMPLETED"}
    assert store.load("entities", entities)[0] == "REJECTED"  # stored already
    assert store.table("entities").count() == 2
    only_first = _csv(tmp_path / "f.csv", [ENTITY])
    assert store.load("entities", only_first, mode="REPLACE", import_id="IMP-1", received_at=when)[0] == "ROLLED_BACK"
    assert store.table("entities").count() == 2  # the asset still has its entity
    only_second = _csv(tmp_path / "g.csv", [dict(ENTITY, entity_id="ENT-02"), dict(ENTITY, entity_id="ENT-03"), dict(ENTITY, entity_id="ENT-04")])
    assert store.load("entities", only_second, mode="REPLACE")[0] == "COMPLETED"
    assert store.table("entities").count() == 3 and store.tables().assets.count() == 1
    failed = store.import_of("IMP-1").first()
    assert (failed["status"], failed["accepted_count"], failed["rejected_count"], failed["row_count"]) == ("ROLLED_BACK", 0, 1, 1)
    assert store.log().count() == 6 and store.import_of("none").count() == 0
    before = store.log().count()
    assert store.check("entities", entities).error_count == 1 and store.log().count() == before
    with pytest.raises(ValueError):
        store.check("entities", entities, mode="MERGE")
    types = {r["dataset_type"]: r for r in dataset_types(spark).collect()}
    assert list(types) and types["assets"]["optional_columns"] == ["expected_telemetry"]


def test_export_can_be_read_back(spark, tmp_path):
    t = world(spark, assets=[{}, dict(asset_id="AST-2", monitoring_expected=False, expected_telemetry=None)])
    manifest = export({"entities": t.entities, "assets": t.assets}, str(tmp_path / "out"))
    assert {r["table"]: r["rows"] for r in manifest.collect()} == {"entities": 1, "assets": 2}
    for fmt in ("csv", "jsonl"):
        back = _check(spark, "assets", str(tmp_path / "out" / f"assets.{fmt}"))
        assert back.is_valid and back.accepted.exceptAll(t.assets).count() == 0
    head = spark.read.text(str(tmp_path / "out" / "assets.csv")).where("value like 'AST-2%'").first()[0]
    assert ",False,,2024-01-01 00:00:00+00:00" in head


def test_audit(spark):
    good, steps = workflow("INV-1", "OPEN VALIDATE CLOSE", started_at=START)
    bad, more = workflow("INV-2", "OPEN CLOSE CLOSE", started_at=START, ended_at=START)
    more[1]["sequence_number"] = 5
    more[2].update(sequence_number=6, occurred_at=START - DAY)
    t = world(
        spark, assets=[{}, dict(asset_id="AST-2", expected_telemetry=None), dict(asset_id="AST-3", criticality="LOW", monitoring_expected=False)],
        alerts=[dict(alert_id="ALR-1"), dict(alert_id="ALR-1"), dict(alert_id="ALR-2", acknowledged_at=START)],
        investigations=[good, bad], investigation_actions=steps + more,
        escalations=[dict(alert_id="ALR-9"), dict(escalation_id="ESC-2")],
        telemetry=[dict(asset_id="AST-3")],
    )
    found = {r["check"]: r["violations"] for r in audit.audit(t).collect() if r["violations"]}
    assert found == {
        "alerts: key unique": 1,
        "alerts: acknowledged_at not before created_at": 1,
        "escalations: alert_id exists": 1,
        "investigation_actions: numbers run 1..n": 1,
        "investigation_actions: time does not go back": 1,
        "investigation_actions: within the investigation": 3,
        "assets: severe ones are monitored": 1,
        "telemetry: only of monitored assets": 1,
    }
    assert set(validate._MESSAGES) == {*V.STRUCTURAL_CODES, *V.SEMANTIC_CODES}
