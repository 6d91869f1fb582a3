"""Small hand-made tables for unit tests: rows with defaults for what a test ignores."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from opsreview.schemas import DATASETS
from opsreview.sources.tables import Tables

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
END = datetime(2024, 7, 1, tzinfo=timezone.utc)
HOUR, DAY = timedelta(hours=1), timedelta(days=1)


def month(n: int) -> datetime:
    """The first day of the n-th month counted from START (0-based)."""
    return START.replace(year=2024 + n // 12, month=n % 12 + 1)


_DEFAULTS = {
    "entities": dict(
        entity_id="ENT-01", name="One", sector="FINANCE", peer_group="A", scale="SMALL", asset_count_estimate=10,
        analyst_headcount=2, created_at=START, data_period_start=START, data_period_end=END,
    ),
    "assets": dict(
        asset_id="AST-1", entity_id="ENT-01", name="a", category="SERVER", criticality="CRITICAL",
        monitoring_expected=True, expected_telemetry="DNS", created_at=START,
    ),
    "alerts": dict(
        alert_id="ALR-1", entity_id="ENT-01", asset_id="AST-1", severity="CRITICAL", category="MALWARE",
        detection_source="ENDPOINT", status="CLOSED", created_at=START + DAY, acknowledged_at=START + DAY,
        closed_at=None, recurrence_key=None, is_true_positive=True,
    ),
    "investigations": dict(
        investigation_id="INV-1", alert_id="ALR-1", entity_id="ENT-01", analyst_id="ANALYST-1", status="CLOSED",
        started_at=START + DAY, ended_at=None, duration_seconds=3600, evidence_count=4,
    ),
    "investigation_actions": dict(
        action_id="ACT-1", investigation_id="INV-1", sequence_number=1, action_type="OPEN",
        occurred_at=START + DAY, duration_seconds=None, outcome=None,
    ),
    "escalations": dict(
        escalation_id="ESC-1", alert_id=None, investigation_id=None, created_at=START + DAY, target="TIER2",
        reason="SEVERITY", status="RESOLVED", resolved_at=None,
    ),
    "remediations": dict(
        remediation_id="REM-1", alert_id=None, investigation_id=None, created_at=START + DAY, completed_at=None,
        remediation_type="PATCH", status="COMPLETED", successful=None,
    ),
    "telemetry": dict(
        telemetry_id="TLM-1", entity_id="ENT-01", asset_id="AST-1", period_start=START, period_end=START + DAY,
        category="DNS", event_count=1, activity_level=1.0, source_status="HEALTHY", expected=True,
    ),
    "performance_metrics": dict(
        metric_id="PMET-1", entity_id="ENT-01", period_start=START, period_end=month(1), mttr_hours=5.0,
        closure_rate=0.5, sla_compliance=0.5, escalation_rate=0.5, investigation_completeness=0.5,
        recurrence_rate=0.5, remediation_rate=0.5, evidence_completeness=0.5,
    ),
}


def world(spark, **rows: list[dict]) -> Tables:
    """Tables from partial rows; one default entity unless entities are given."""
    rows.setdefault("entities", [{}])
    frames = {}
    for name, dataset in DATASETS.items():
        full = [{**_DEFAULTS[name], **r} for r in rows.get(name, [])]
        data = [tuple(r[f.name] for f in dataset.fields) for r in full]
        frames[name] = spark.createDataFrame(data, dataset.struct)
    return Tables(**frames)


def monthly_kpis(n: int, entity: str = "ENT-01", **series) -> list[dict]:
    """``n`` monthly KPI rows; a series is a list of values or a function of the index."""
    rows = []
    for i in range(n):
        values = {k: float(v(i) if callable(v) else v[i]) for k, v in series.items()}
        rows.append(
            dict(metric_id=f"PMET-{entity[4:]}{i:03d}", entity_id=entity, period_start=month(i), period_end=month(i + 1), **values)
        )
    return rows


def workflow(inv: str, actions: str, alert: str | None = None, **more) -> tuple[dict, list[dict]]:
    """An investigation and its actions, given as a space-separated list of types."""
    number = inv.split("-")[1]
    investigation = dict(investigation_id=inv, alert_id=alert or f"ALR-{number}", **more)
    steps = [
        dict(action_id=f"ACT-{number}{i:03d}", investigation_id=inv, sequence_number=i, action_type=a)
        for i, a in enumerate(actions.split(), start=1)
    ]
    return investigation, steps


def keys(df) -> list[str]:
    return sorted(r[0] for r in df.select("finding_key").collect())
