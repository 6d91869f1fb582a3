"""Work that an alert called for and that no record shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsreview.config import ExecutionGapConfig
from opsreview.functions.expr import hours_between, severity_at_least
from opsreview.operators.rollups import remediated_alerts
from opsreview.sources.tables import Tables

COLUMNS = (
    "finding_key", "rule_id", "gap_type", "reason_code", "entity_id", "asset_id", "alert_id",
    "investigation_id", "recurrence_key", "n_related_alerts", "observed_at", "window_start",
    "window_end", "alert_severity", "summary", "expected_condition", "observed_condition",
)


def _shape(df: DataFrame, rule: str, gap: str, reason: str) -> DataFrame:
    """Bring a rule's rows to the common columns; columns it lacks become NULL."""
    fixed = {"rule_id": F.lit(rule), "gap_type": F.lit(gap), "reason_code": F.lit(reason)}
    empty = {
        "n_related_alerts": F.lit(0).cast("bigint"),
        "alert_id": F.lit(None).cast("string"),
        "investigation_id": F.lit(None).cast("string"),
        "recurrence_key": F.lit(None).cast("string"),
        "observed_at": F.lit(None),
        "window_start": F.lit(None),
        "window_end": F.lit(None),
    }
    return df.select(
        *[
            fixed[c].alias(c) if c in fixed else F.col(c) if c in df.columns else empty[c].alias(c)
            for c in COLUMNS
        ]
    )


def unescalated_alerts(tables: Tables, config: ExecutionGapConfig) -> DataFrame:
    """EG-001: confirmed critical alerts, investigated and closed, never escalated.

    An escalation counts by its alert or by its investigation. The two links are two
    anti joins in a row; one join on "either" could not be a hash join.
    """
    alerts = tables.alerts.where(
        severity_at_least("severity", config.escalation_min_severity) & (F.col("status") == "CLOSED")
    )
    if config.escalation_require_true_positive:
        alerts = alerts.where("is_true_positive")
    escalated = tables.escalations
    gaps = (
        alerts.select("alert_id", "entity_id", "asset_id", "severity", "created_at", "closed_at")
        .join(tables.investigations.select("alert_id", "investigation_id"), "alert_id")
        .join(escalated.where("alert_id is not null").select("alert_id"), "alert_id", "left_anti")
        .join(
            escalated.where("investigation_id is not null").select("investigation_id"),
            "investigation_id",
            "left_anti",
        )
    )
    severity, alert = F.col("severity"), F.col("alert_id")
    return _shape(
        gaps.select(
            "*",
            F.concat(F.lit("EG-001:"), alert).alias("finding_key"),
            F.coalesce("closed_at", "created_at").alias("observed_at"),
            severity.alias("alert_severity"),
            F.format_string(
                "Confirmed %s alert %s was closed after an investigation; the data hold no escalation for it.",
                severity, alert,
            ).alias("summary"),
            F.format_string("At least one escalation for a confirmed %s alert.", severity).alias("expected_condition"),
            F.lit("Neither the alert nor its investigation appears in an escalation.").alias("observed_condition"),
        ),
        "EG-001", "ESCALATION_GAP", "CRITICAL_ALERT_NO_ESCALATION",
    )


def uninvestigated_alerts(tables: Tables, config: ExecutionGapConfig) -> DataFrame:
    """EG-002: acknowledged alerts without an investigation, long enough before the
    end of the entity's data for one to be expected."""
    waiting = (
        tables.alerts.where(
            F.col("acknowledged_at").isNotNull()
            & (F.col("status") == "ACKNOWLEDGED")
            & severity_at_least("severity", config.investigation_min_severity)
        )
        .select("alert_id", "entity_id", "asset_id", "severity", "acknowledged_at")
        .join(tables.investigations.select("alert_id"), "alert_id", "left_anti")
        .join(tables.entities.select("entity_id", "data_period_end"), "entity_id")
        .where(
            hours_between("acknowledged_at", "data_period_end")
            >= F.lit(float(config.investigation_expected_within_hours))
        )
    )
    severity, alert = F.col("severity"), F.col("alert_id")
    return _shape(
        waiting.select(
            "*",
            F.concat(F.lit("EG-002:"), alert).alias("finding_key"),
            F.col("acknowledged_at").alias("observed_at"),
            F.col("acknowledged_at").alias("window_start"),
            F.col("data_period_end").alias("window_end"),
            severity.alias("alert_severity"),
            F.format_string(
                "%s alert %s was acknowledged; the data hold no investigation of it.", severity, alert
            ).alias("summary"),
            F.format_string(
                f"An investigation of an acknowledged %s alert within {config.investigation_expected_within_hours:g}h.",
                severity,
            ).alias("expected_condition"),
            F.lit("The alert is still acknowledged and no investigation names it.").alias("observed_condition"),
        ),
        "EG-002", "INVESTIGATION_GAP", "ACKNOWLEDGED_ALERT_NO_INVESTIGATION",
    )


def _recurring(tables: Tables) -> DataFrame:
    return tables.alerts.where(F.col("is_true_positive") & F.col("recurrence_key").isNotNull())


def unremediated_recurrences(tables: Tables, config: ExecutionGapConfig) -> DataFrame:
    """EG-003: confirmed alerts that keep recurring and none of which was remediated.

    Only mergeable aggregates are used, so a key that holds a large share of all
    alerts is reduced on the map side. The ids of the group stay rows; see
    :func:`recurrence_members`.
    """
    groups = (
        _recurring(tables)
        .select("alert_id", "entity_id", "asset_id", "severity", "created_at", "recurrence_key")
        .join(remediated_alerts(tables).withColumn("remediated", F.lit(True)), "alert_id", "left")
        .groupBy("entity_id", "recurrence_key")
        .agg(
            F.count("*").alias("n_related_alerts"),
            F.coalesce(F.bool_or("remediated"), F.lit(False)).alias("remediated"),
            F.min("created_at").alias("window_start"),
            F.max("created_at").alias("window_end"),
            F.min_by("asset_id", "alert_id").alias("asset_id"),
            F.min_by("severity", "alert_id").alias("alert_severity"),
        )
        .where(
            (F.col("n_related_alerts") >= config.remediation_min_recurring_true_positives)
            & ~F.col("remediated")
        )
    )
    return _shape(
        groups.select(
            "*",
            F.concat_ws(":", F.lit("EG-003"), "entity_id", "recurrence_key").alias("finding_key"),
            F.format_string(
                "%d confirmed alerts recurred on asset %s; the data hold no completed remediation for them.",
                F.col("n_related_alerts"), F.col("asset_id"),
            ).alias("summary"),
            F.lit("At least one completed remediation within a group of recurring confirmed alerts.").alias("expected_condition"),
            F.lit("No completed remediation names an alert of the group.").alias("observed_condition"),
        ),
        "EG-003", "REMEDIATION_GAP", "RECURRING_CONFIRMED_ALERTS_NO_REMEDIATION",
    )


def recurrence_members(tables: Tables, findings: DataFrame) -> DataFrame:
    """The alerts behind each EG-003 finding, one row per alert."""
    groups = findings.where("rule_id = 'EG-003'").select(
        "entity_id", "recurrence_key", "finding_key", "window_start", "expected_condition"
    )
    return _recurring(tables).select("entity_id", "recurrence_key", "alert_id").join(
        groups, ["entity_id", "recurrence_key"]
    )


RULES: dict[str, Callable[[Tables, ExecutionGapConfig], DataFrame]] = {
    "EG-001": unescalated_alerts,
    "EG-002": uninvestigated_alerts,
    "EG-003": unremediated_recurrences,
}


def detect(
    tables: Tables, config: ExecutionGapConfig = ExecutionGapConfig(), enabled: tuple[str, ...] = tuple(RULES)
) -> DataFrame:
    """All findings of the enabled rules."""
    parts = [RULES[rule](tables, config) for rule in enabled]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
