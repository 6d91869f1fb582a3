from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from opsreview import vocab as V
from opsreview.config import AnomalyConfig, AssessmentConfig
from opsreview.operators import confidence, evaluate, evidence, findings, queue
from opsreview.plans.assessment import assess
from tests.world import DAY, START, monthly_kpis, workflow, world

T1, T2 = datetime(2024, 2, 1, tzinfo=timezone.utc), datetime(2024, 2, 2, tzinfo=timezone.utc)


def _labelled(spark, labels):
    array = "array(" + ", ".join(f"'{x}'" for x in labels) + ")" if labels else "cast(array() as array<string>)"
    return spark.sql(f"SELECT {array} AS f")


@pytest.mark.parametrize(
    "labels, refs, absences, expected",
    [
        ([], 0, 0, "LOW"),
        (["MULTIPLE_DIRECT_RECORDS"], 1, 1, "LOW"),
        (["MULTIPLE_DIRECT_RECORDS", "SMALL_BASELINE"], 5, 0, "LOW"),
        (["ABSENCE_BASED", "MULTIPLE_DIRECT_RECORDS"], 4, 1, "MODERATE"),
        (["ABSENCE_BASED", "MINIMUM_THRESHOLD"], 4, 1, "LOW"),
        (["SINGLE_RECORD"], 2, 0, "MODERATE"),
        (["MULTIPLE_DIRECT_RECORDS", "LARGE_COMPARISON_POP"], 5, 0, "HIGH"),
    ],
)
def test_level(spark, labels, refs, absences, expected):
    df = _labelled(spark, labels).select(confidence.level(F.col("f"), F.lit(refs), F.lit(absences)).alias("x"))
    assert df.first()[0] == expected


@pytest.mark.parametrize(
    "n, fragile, label",
    [(0, False, None), (2, False, "SMALL_BASELINE"), (2, True, "FRAGILE_BASELINE"), (3, False, "MODERATE_BASELINE"), (6, False, "LARGE_COMPARISON_POP")],
)
def test_baseline_factor(spark, n, fragile, label):
    from opsreview.functions.expr import kept

    df = spark.range(1).select(kept(*confidence.baseline_factors(F.lit(n), fragile=F.lit(fragile))))
    assert df.first()[0] == ([label] if label else [])


def test_confidence_needs_no_function_over_arrays(spark):
    n = F.col("n")
    factors = [(n < 3, "SMALL_BASELINE"), (n > 0, "ABSENCE_BASED"), (n < 5, "SINGLE_RECORD"), (n < 9, "SMALL_BASELINE"), (n == 1, "MINIMUM_THRESHOLD"), (n == 1, "PARTIAL_OBSERVATIONS")]
    df = confidence.annotate(spark.createDataFrame([(None,), (1,), (6,), (9,)], "n int"), factors, n, n, F.lit(0))
    thin, point = "Thinly supported: ", ". Take it as a first pointer."
    within = "Supported by records, within limits: small gaps in the data."
    small = ["SMALL_BASELINE", "ABSENCE_BASED"]
    assert [tuple(r)[1:4] for r in df.orderBy("n").collect()] == [
        ("HIGH", [], "Rests on null source records without notable gaps."),
        ("LOW", [*small, "SINGLE_RECORD", "MINIMUM_THRESHOLD", "PARTIAL_OBSERVATIONS"], thin + "small baseline; single record; minimum threshold" + point),
        ("LOW", ["ABSENCE_BASED", "SMALL_BASELINE"], thin + "small baseline" + point),
        ("MODERATE", ["ABSENCE_BASED"], within),
    ]
    assert "lambda" not in df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def run(spark):
    """A small world in which most detectors find something."""
    flows = [workflow(f"INV-{i}", "OPEN CLOSE", started_at=START + DAY) for i in range(1, 5)]
    flows.append(workflow("INV-5", "CORRELATION ESCALATE ASSET_LOOKUP VALIDATE", started_at=START + 2 * DAY))
    recurring = [dict(alert_id=f"ALR-{i}", recurrence_key="K", severity="HIGH") for i in (7, 8, 9)]
    kpis = monthly_kpis(
        6, closure_rate=lambda i: 0.1 * i, sla_compliance=lambda i: 0.1 * i, evidence_completeness=lambda i: 0.9 - 0.1 * i,
    )
    peers = [r for e in ("ENT-02", "ENT-03", "ENT-04") for r in monthly_kpis(1, e, closure_rate=[0.9])]
    tables = world(
        spark,
        entities=[dict(entity_id=f"ENT-0{i}") for i in (1, 2, 3, 4)],
        assets=[dict(asset_id="AST-1"), dict(asset_id="AST-2")],
        alerts=[dict(alert_id=f"ALR-{i}") for i in range(1, 6)] + recurring,
        investigations=[f[0] for f in flows],
        investigation_actions=[a for f in flows for a in f[1]],
        telemetry=[dict(telemetry_id=f"TLM-{i}", asset_id="AST-2") for i in (1, 2)],
        performance_metrics=kpis + peers,
    )
    return assess(tables, AssessmentConfig(anomaly=AnomalyConfig(min_training_samples=3, n_estimators=10)))


def test_evidence_is_complete_and_real(run):
    counts = run.evidence.groupBy("finding_key").agg(F.countDistinct("source_type", "source_id").alias("n"), F.count("*").alias("rows"))
    joined = run.findings.join(counts, "finding_key", "full")
    assert joined.where("n is null or evidence_count is null or n <> evidence_count or rows <> n").count() == 0
    assert evidence.unsupported_refs(run.tables, run.evidence).count() == 0
    assert {r[0] for r in run.findings.select("analytic_id").distinct().collect()} >= {"EG-001", "NS-001", "PB-001", "MRD-001", "IF-REP-001", "IF-DEV-002", "IF-MEA-003"}


def test_unsupported_refs_are_seen(spark, run):
    fake = spark.createDataFrame([("k", "EG-001", "ALERT", "ALR-404", "r", None, "x")], run.evidence.schema)
    assert evidence.unsupported_refs(run.tables, fake).count() == 1
    twice = fake.unionByName(fake.withColumn("role", F.lit("a")))
    assert [r["role"] for r in evidence.unique_refs(twice).collect()] == ["a"]


def test_findings_views(run):
    total = run.findings.count()
    assert findings.select_findings(run.findings, category="EXECUTION_GAP").select("analytic_id").distinct().collect()[0][0] == "EG-001"
    assert findings.select_findings(run.findings, entity_id="nobody").count() == 0
    first, second = findings.page(run.findings, 3), findings.page(run.findings, total, 3)
    listed = [r["finding_key"] for r in first.collect() + second.collect()]
    assert listed == sorted(listed) and len(listed) == total
    assert findings.one(run.findings, listed[0]).count() == 1
    for bad in (dict(limit=0), dict(limit=501), dict(offset=-1)):
        with pytest.raises(ValueError):
            findings.page(run.findings, **bad)
    counted = {r[0]: r[1] for r in findings.count_by(run.findings, "category", V.FINDING_CATEGORIES).collect()}
    assert set(counted) == set(V.FINDING_CATEGORIES) and sum(counted.values()) == total
    details = findings.select_findings(run.findings, analytic_id="MRD-001").first()["details"]
    assert details["supporting_period_count"] == "6" and "alert_id" not in details
    assert findings.key_hash(run.findings.repartition(7)).first() == findings.key_hash(run.findings.repartition(1)).first()
    summary = {r["analytic_id"]: r["finding_count"] for r in run.summary.collect()}
    assert summary["TOTAL"] == total and summary["ENTITIES"] == 4


def test_wording_is_neutral(run):
    text = " ".join(r[0].lower() for r in run.findings.select(F.concat_ws(" ", "summary", "confidence_note")).collect())
    for word in ("negligen", "misconduct", "fraud", "blame", "fault", "incompeten", "malicious", "guilty"):
        assert word not in text


def _priority(spark, kind, severity=None, conf="HIGH", n=3, analytic="X"):
    df = spark.createDataFrame([(analytic, kind, severity, conf, n)], "a string, k string, s string, c string, n long")
    return df.select(queue.priority_of(*[F.col(x) for x in "akscn"])).first()[0]


def test_priority(spark):
    assert _priority(spark, "CRITICAL_ALERT_NO_ESCALATION") == "HIGH"
    assert _priority(spark, "CRITICAL_ALERT_NO_ESCALATION", "CRITICAL") == "CRITICAL"
    assert _priority(spark, "CRITICAL_ALERT_NO_ESCALATION", "CRITICAL", "LOW") == "HIGH"
    assert _priority(spark, "MISSING_EXPECTED_ACTION", "HIGH", "LOW") == "MEDIUM"
    assert _priority(spark, "SEQUENCE_DEVIATION", None, "LOW", 0) == "LOW"
    assert _priority(spark, "ANYTHING") == "MEDIUM" and _priority(spark, "ANYTHING", n=0) == "LOW"
    assert _priority(spark, "ANYTHING", analytic="MRD-001") == "HIGH"
    assert _priority(spark, "REPETITIVE_WORKFLOW", "MEDIUM") == "LOW"


def test_title_fallback(spark):
    df = spark.range(1).select(queue.title_of(F.lit("SOME_NEW_TYPE"), F.lit("ENT-01")), queue.title_of(F.lit("ANOMALOUS"), F.lit("ENT-01")))
    assert list(df.first()) == ["Potential Some New Type — ENT-01", "Potential Operational Anomaly — ENT-01"]


def test_merge_is_idempotent_and_keeps_decisions(spark, run):
    items = queue.items(run.findings)
    first = run.queue(queue.empty(spark), T1)
    n = first.count()
    assert {r[0] for r in first.select("outcome").distinct().collect()} == {"INSERTED"}
    decided = first.drop("outcome").withColumn("status", F.lit("DISMISSED")).withColumn("review_note", F.lit("seen"))
    second = queue.merge(decided, items, T2)
    assert second.where("outcome = 'UNCHANGED' and status = 'DISMISSED' and review_note = 'seen'").count() == n
    assert second.where(F.col("updated_at") == F.lit(T2)).count() == n and second.where(F.col("created_at") == F.lit(T1)).count() == n
    moved = items.withColumn("finding_version", F.lit("other"))
    third = queue.merge(decided, moved, T2)
    assert third.where("outcome = 'UPDATED' and status = 'OPEN' and review_note is null and reviewer_ref is null").count() == n
    gone = queue.merge(decided, items.where("analytic_id = 'EG-001'"), T2)
    assert gone.count() == n and gone.where("outcome = 'KEPT' and status = 'DISMISSED'").count() == n - items.where("analytic_id = 'EG-001'").count()


def test_all_moves(spark):
    states = V.REVIEW_STATUSES
    rows = [(f"q-{a}-{b}", a, b) for a in states for b in states]
    base = {f.name: None for f in queue.SCHEMA}
    data = [tuple({**base, "queue_id": q, "finding_key": q, "status": a, "created_at": T1, "updated_at": T1, "reviewer_ref": "old", "review_note": "old"}.values()) for q, a, _ in rows]
    items = spark.createDataFrame(data, queue.SCHEMA)
    asked = [(q, b, "new", "note", 1) for q, _, b in rows] + [("nowhere", "OPEN", None, None, 1), ("q-OPEN-REVIEWED", "OPEN", None, None, 2)]
    requests = spark.createDataFrame(asked, "queue_id string, new_status string, reviewer_ref string, review_note string, request_no int")
    judged = queue.judge_moves(items, requests)
    results = {(r["queue_id"], r["request_no"]): r["result"] for r in judged.collect()}
    for q, a, b in rows:
        assert results[(q, 1)] == ("APPLIED" if (a, b) in V.ALLOWED_MOVES else "INVALID_TRANSITION")
    assert results[("nowhere", 1)] == "NOT_FOUND" and results[("q-OPEN-REVIEWED", 2)] == "NOT_FIRST"
    after = {r["queue_id"]: r for r in queue.apply_moves(items, judged, T2).collect()}
    assert len(after) == 16
    reviewed, taken, reopened, refused = (after[f"q-{x}"] for x in ("OPEN-DISMISSED", "OPEN-IN_REVIEW", "DISMISSED-OPEN", "DISMISSED-REVIEWED"))
    assert (reviewed["status"], reviewed["reviewer_ref"], reviewed["review_note"]) == ("DISMISSED", "new", "note") and reviewed["reviewed_at"]
    assert (taken["status"], taken["reviewer_ref"], taken["review_note"], taken["reviewed_at"]) == ("IN_REVIEW", "new", "old", None)
    assert (reopened["status"], reopened["reviewer_ref"], reopened["review_note"]) == ("OPEN", "old", "old")
    assert refused["status"] == "DISMISSED" and refused["reviewer_ref"] == "old"


def test_queue_views_and_versions(spark, run, tmp_path):
    state = run.queue(queue.empty(spark), T1)
    queue.save(state, str(tmp_path / "q"), 1)
    queue.save(state.withColumn("status", F.lit("IN_REVIEW")), str(tmp_path / "q"), 2)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        queue.save(state, str(tmp_path / "q"), 2)
    newest, older = queue.load(spark, str(tmp_path / "q")), queue.load(spark, str(tmp_path / "q"), 1)
    n = state.count()
    assert newest.where("status = 'IN_REVIEW'").count() == n and older.where("status = 'OPEN'").count() == n
    page = [V.PRIORITIES.index(r["priority"]) for r in queue.page(older, 200).collect()]
    assert page == sorted(page, reverse=True)
    assert queue.select_items(older, status="open").count() == n
    for bad in (dict(status="LATER"), dict(priority="URGENT"), dict(category="X")):
        with pytest.raises(ValueError):
            queue.select_items(older, **bad)
    with pytest.raises(ValueError):
        queue.page(older, 201)
    counts = {(r[0], r[1]): r[2] for r in queue.summary(older).collect()}
    assert len(counts) == 15 and counts[("total", "ALL")] == n and counts[("status", "DISMISSED")] == 0
    assert queue.one(older, older.first()["queue_id"]).count() == 1


def test_evaluation(spark, run):
    planted = [
        ("CRITICAL_ALERT_WITHOUT_ESCALATION", "ENT-01", None),
        ("TELEMETRY_DISAPPEARANCE", "ENT-02", None),
        ("NORMAL_BASELINE", "ENT-03", "NONE"),
        ("SUSPICIOUSLY_FAST_INVESTIGATION", "ENT-01", "INVESTIGATION_QUALITY"),
    ]
    truth = spark.createDataFrame(planted, "scenario_type string, entity_id string, expected_detection_category string")
    verdicts = {r["scenario_type"]: r["verdict"] for r in evaluate.evaluate(truth, run.findings).collect()}
    assert verdicts == {
        "CRITICAL_ALERT_WITHOUT_ESCALATION": "DETECTED", "TELEMETRY_DISAPPEARANCE": "MISSED",
        "NORMAL_BASELINE": "CONTROL_CLEAN", "SUSPICIOUSLY_FAST_INVESTIGATION": "DETECTED",
    }


def test_outcomes_of_a_second_run(spark):
    from opsreview.operators import entities, queue

    rows = spark.createDataFrame([("INSERTED",), ("INSERTED",), ("KEPT",)], "outcome string")
    assert {r["outcome"]: r["n"] for r in queue.outcomes(rows).collect()} == {"INSERTED": 2, "UPDATED": 0, "UNCHANGED": 0, "KEPT": 1, "TOTAL": 3}
    assert {r["n"] for r in queue.outcomes(rows.limit(0)).collect()} == {0}
    ids = spark.createDataFrame([(f"ENT-{k:02}",) for k in range(30)], "entity_id string")
    assert [r[0] for r in entities.page(ids, 2, after="ENT-07").collect()] == ["ENT-08", "ENT-09"]
    assert [r[0] for r in entities.one(ids, "ENT-03").collect()] == ["ENT-03"]
