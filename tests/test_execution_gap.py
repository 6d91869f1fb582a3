import pytest

from opsreview.config import ExecutionGapConfig
from opsreview.operators import execution_gap as eg
from tests.world import DAY, END, HOUR, START, keys, world

CONFIG = ExecutionGapConfig()


def test_unescalated_needs_every_condition(spark):
    alerts = [
        dict(alert_id="ALR-1"),
        dict(alert_id="ALR-2", severity="HIGH"),
        dict(alert_id="ALR-3", status="ACKNOWLEDGED"),
        dict(alert_id="ALR-4", is_true_positive=False),
        dict(alert_id="ALR-5", is_true_positive=None),
        dict(alert_id="ALR-6"),  # not investigated
        dict(alert_id="ALR-7"),  # escalated by the alert
        dict(alert_id="ALR-8"),  # escalated by the investigation only
    ]
    investigations = [dict(investigation_id=f"INV-{i}", alert_id=f"ALR-{i}") for i in (1, 2, 3, 4, 5, 7, 8)]
    escalations = [
        dict(escalation_id="ESC-1", alert_id="ALR-7"),
        dict(escalation_id="ESC-2", investigation_id="INV-8", status="REJECTED"),
    ]
    t = world(spark, alerts=alerts, investigations=investigations, escalations=escalations)
    assert keys(eg.unescalated_alerts(t, CONFIG)) == ["EG-001:ALR-1"]
    loose = ExecutionGapConfig(escalation_min_severity="HIGH", escalation_require_true_positive=False)
    assert keys(eg.unescalated_alerts(t, loose)) == [f"EG-001:ALR-{i}" for i in (1, 2, 4, 5)]


def test_unescalated_is_observed_at_closing_time(spark):
    alerts = [dict(alert_id="ALR-1", closed_at=START + 3 * DAY), dict(alert_id="ALR-2")]
    investigations = [dict(investigation_id=f"INV-{i}", alert_id=f"ALR-{i}") for i in (1, 2)]
    rows = eg.unescalated_alerts(world(spark, alerts=alerts, investigations=investigations), CONFIG)
    seen = {r["alert_id"]: r["observed_at"] for r in rows.collect()}
    assert seen["ALR-1"] - seen["ALR-2"] == 2 * DAY


@pytest.mark.parametrize("hours, found", [(23.999, False), (24.0, True), (25.0, True)])
def test_uninvestigated_waits_for_the_threshold(spark, hours, found):
    alert = dict(status="ACKNOWLEDGED", severity="HIGH", acknowledged_at=END - hours * HOUR)
    assert (eg.uninvestigated_alerts(world(spark, alerts=[alert]), CONFIG).count() == 1) is found


def test_uninvestigated_skips_other_states(spark):
    base = dict(status="ACKNOWLEDGED", severity="HIGH")
    alerts = [
        dict(base, alert_id="ALR-1", acknowledged_at=None),
        dict(base, alert_id="ALR-2", severity="MEDIUM"),
        dict(base, alert_id="ALR-3", status="CLOSED"),
        dict(base, alert_id="ALR-4"),
        dict(base, alert_id="ALR-5"),
    ]
    t = world(spark, alerts=alerts, investigations=[dict(alert_id="ALR-4")])
    assert keys(eg.uninvestigated_alerts(t, CONFIG)) == ["EG-002:ALR-5"]


def test_recurrences(spark):
    def group(entity, key, ids, **more):
        return [dict(alert_id=f"ALR-{i}", entity_id=entity, recurrence_key=key, created_at=START + i * DAY, **more) for i in ids]

    alerts = (
        group("ENT-01", "K", (3, 1, 2), asset_id="AST-9")
        + group("ENT-02", "K", (11, 12))  # too few
        + group("ENT-02", "L", (21, 22, 23))  # one remediated by its alert
        + group("ENT-02", "M", (31, 32, 33))  # one remediated by its investigation
        + group("ENT-02", "N", (41, 42, 43))  # remediation not completed
        + group("ENT-02", "O", (51, 52, 53), is_true_positive=False)
    )
    remediations = [
        dict(remediation_id="REM-1", alert_id="ALR-22"),
        dict(remediation_id="REM-2", investigation_id="INV-3"),
        dict(remediation_id="REM-3", alert_id="ALR-42", status="FAILED"),
    ]
    entities = [dict(entity_id="ENT-01"), dict(entity_id="ENT-02")]
    t = world(
        spark, entities=entities, alerts=alerts, remediations=remediations,
        investigations=[dict(investigation_id="INV-3", alert_id="ALR-33")],
    )
    found = eg.unremediated_recurrences(t, CONFIG)
    assert keys(found) == ["EG-003:ENT-01:K", "EG-003:ENT-02:N"]
    first = found.where("entity_id = 'ENT-01'").first()
    assert (first["n_related_alerts"], first["asset_id"]) == (3, "AST-9")
    assert first["window_end"] - first["window_start"] == 2 * DAY
    members = eg.recurrence_members(t, found).where("entity_id = 'ENT-01'")
    assert sorted(r["alert_id"] for r in members.collect()) == ["ALR-1", "ALR-2", "ALR-3"]


def test_rules_can_be_switched_off(spark):
    t = world(spark, alerts=[{}], investigations=[{}])
    assert keys(eg.detect(t)) == ["EG-001:ALR-1"]
    assert keys(eg.detect(t, enabled=("EG-002", "EG-003"))) == []


def test_scope(spark):
    alerts = [dict(alert_id="ALR-1"), dict(alert_id="ALR-2", entity_id="ENT-02")]
    t = world(
        spark, entities=[{}, dict(entity_id="ENT-02")], alerts=alerts,
        investigations=[dict(investigation_id=f"INV-{i}", alert_id=f"ALR-{i}", entity_id=f"ENT-0{i}") for i in (1, 2)],
    )
    assert keys(eg.detect(t.scoped(None))) == ["EG-001:ALR-1", "EG-001:ALR-2"]
    assert keys(eg.detect(t.scoped(["ENT-02"]))) == ["EG-001:ALR-2"]
    assert keys(eg.detect(t.scoped([]))) == []
    wanted = spark.createDataFrame([("ENT-01",)], "entity_id string")
    assert keys(eg.detect(t.scoped(wanted))) == ["EG-001:ALR-1"]


@pytest.mark.parametrize(
    "bad",
    [
        dict(investigation_expected_within_hours=-1.0),
        dict(remediation_min_recurring_true_positives=0),
        dict(escalation_min_severity="URGENT"),
    ],
)
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        ExecutionGapConfig(**bad)
