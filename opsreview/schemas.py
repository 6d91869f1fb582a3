"""The nine datasets: columns, keys, references and ordering rules.

The registry is the only description of the data model. It yields the Spark
``StructType`` of a stored dataset and drives file validation; nothing is
inferred from data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from opsreview import vocab as V

_SPARK_TYPES = {
    "string": T.StringType(),
    "enum": T.StringType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


@dataclass(frozen=True)
class Field:
    """One column. ``optional`` columns may be absent and their values NULL."""

    name: str
    kind: str = "string"
    optional: bool = False
    values: tuple[str, ...] = ()
    id_prefix: str | None = None
    references: str | None = None
    minimum: float | None = None
    maximum: float | None = None

    @property
    def id_pattern(self) -> str | None:
        return rf"^{self.id_prefix}-\d+$" if self.id_prefix else None


@dataclass(frozen=True)
class Dataset:
    """A dataset; its first field is the primary key."""

    name: str
    fields: tuple[Field, ...]
    ordered: tuple[tuple[str, str], ...] = ()
    unique: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return self.fields[0].name

    @property
    def required_columns(self) -> list[str]:
        return [f.name for f in self.fields if not f.optional]

    @property
    def optional_columns(self) -> list[str]:
        return [f.name for f in self.fields if f.optional]

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, _SPARK_TYPES[f.kind]) for f in self.fields])


def _id(name: str, prefix: str, references: str | None = None, optional: bool = False) -> Field:
    return Field(name, id_prefix=prefix, references=references, optional=optional)


def _enum(name: str, values: tuple[str, ...], optional: bool = False) -> Field:
    return Field(name, "enum", optional, values)


def _time(name: str, optional: bool = False) -> Field:
    return Field(name, "timestamp", optional)


def _count(name: str, optional: bool = False) -> Field:
    return Field(name, "int", optional, minimum=0)


def _flag(name: str, optional: bool = False) -> Field:
    return Field(name, "boolean", optional)


def _text(name: str, optional: bool = False) -> Field:
    return Field(name, optional=optional)


#: Parents come before children, so loading in this order resolves references.
DATASETS: dict[str, Dataset] = {
    d.name: d
    for d in (
        Dataset(
            "entities",
            (
                _id("entity_id", "ENT"), _text("name"), _enum("sector", V.SECTORS),
                _text("peer_group"), _enum("scale", V.SCALES), _count("asset_count_estimate"),
                _count("analyst_headcount"), _time("created_at"), _time("data_period_start"),
                _time("data_period_end"),
            ),
            ordered=(("data_period_start", "data_period_end"),),
        ),
        Dataset(
            "assets",
            (
                _id("asset_id", "AST"), _id("entity_id", "ENT", "entities"), _text("name"),
                _enum("category", V.ASSET_CATEGORIES), _enum("criticality", V.CRITICALITIES),
                _flag("monitoring_expected"),
                _enum("expected_telemetry", V.TELEMETRY_CATEGORIES, optional=True),
                _time("created_at"),
            ),
        ),
        Dataset(
            "alerts",
            (
                _id("alert_id", "ALR"), _id("entity_id", "ENT", "entities"),
                _id("asset_id", "AST", "assets"), _enum("severity", V.SEVERITIES),
                _enum("category", V.ALERT_CATEGORIES),
                _enum("detection_source", V.DETECTION_SOURCES),
                _enum("status", V.ALERT_STATUSES), _time("created_at"),
                _time("acknowledged_at", optional=True), _time("closed_at", optional=True),
                _text("recurrence_key", optional=True), _flag("is_true_positive", optional=True),
            ),
            ordered=(("created_at", "acknowledged_at"), ("created_at", "closed_at")),
        ),
        Dataset(
            "investigations",
            (
                _id("investigation_id", "INV"), _id("alert_id", "ALR", "alerts"),
                _id("entity_id", "ENT", "entities"), _id("analyst_id", "ANALYST"),
                _enum("status", V.INVESTIGATION_STATUSES), _time("started_at"),
                _time("ended_at", optional=True), _count("duration_seconds", optional=True),
                _count("evidence_count"),
            ),
            ordered=(("started_at", "ended_at"),),
            unique=("alert_id",),
        ),
        Dataset(
            "investigation_actions",
            (
                _id("action_id", "ACT"), _id("investigation_id", "INV", "investigations"),
                _count("sequence_number"), _enum("action_type", V.ACTION_TYPES),
                _time("occurred_at"), _count("duration_seconds", optional=True),
                _enum("outcome", V.ACTION_OUTCOMES, optional=True),
            ),
        ),
        Dataset(
            "escalations",
            (
                _id("escalation_id", "ESC"), _id("alert_id", "ALR", "alerts", optional=True),
                _id("investigation_id", "INV", "investigations", optional=True),
                _time("created_at"), _enum("target", V.ESCALATION_TARGETS),
                _enum("reason", V.ESCALATION_REASONS), _enum("status", V.ESCALATION_STATUSES),
                _time("resolved_at", optional=True),
            ),
            ordered=(("created_at", "resolved_at"),),
        ),
        Dataset(
            "remediations",
            (
                _id("remediation_id", "REM"), _id("alert_id", "ALR", "alerts", optional=True),
                _id("investigation_id", "INV", "investigations", optional=True),
                _time("created_at"), _time("completed_at", optional=True),
                _enum("remediation_type", V.REMEDIATION_TYPES),
                _enum("status", V.REMEDIATION_STATUSES), _flag("successful", optional=True),
            ),
            ordered=(("created_at", "completed_at"),),
        ),
        Dataset(
            "telemetry",
            (
                _id("telemetry_id", "TLM"), _id("entity_id", "ENT", "entities"),
                _id("asset_id", "AST", "assets"), _time("period_start"), _time("period_end"),
                _enum("category", V.TELEMETRY_CATEGORIES), _count("event_count"),
                Field("activity_level", "float", minimum=0),
                _enum("source_status", V.TELEMETRY_STATUSES), _flag("expected"),
            ),
            ordered=(("period_start", "period_end"),),
        ),
        Dataset(
            "performance_metrics",
            (
                _id("metric_id", "PMET"), _id("entity_id", "ENT", "entities"),
                _time("period_start"), _time("period_end"),
                Field("mttr_hours", "float", minimum=0),
                *(
                    Field(name, "float", minimum=0.0, maximum=1.0)
                    for name in V.KPI_NAMES
                    if name != "mttr_hours"
                ),
            ),
            ordered=(("period_start", "period_end"),),
        ),
    )
}

#: Scenarios planted in an evaluation dataset. Read by evaluation only, never by a detector.
GROUND_TRUTH = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("scenario_id", "scenario_type")]
    + [
        T.StructField(n, T.StringType())
        for n in ("entity_id", "asset_id", "alert_id", "investigation_id", "recurrence_key")
    ]
    + [T.StructField(n, T.TimestampType()) for n in ("period_start", "period_end")]
    + [T.StructField(n, T.StringType()) for n in ("expected_detection_category", "reason")]
)
