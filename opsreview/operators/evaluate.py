"""Findings against planted scenarios. Only evaluation reads ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsreview import vocab as V
from opsreview.functions.expr import lookup

#: Detection category a scenario file expects -> finding type of this library.
FINDING_OF_CATEGORY = {
    "ESCALATION_GAP": "CRITICAL_ALERT_NO_ESCALATION",
    "INVESTIGATION_GAP": "ACKNOWLEDGED_ALERT_NO_INVESTIGATION",
    "REMEDIATION_GAP": "RECURRING_CONFIRMED_ALERTS_NO_REMEDIATION",
    "MONITORING_GAP": "CRITICAL_ASSET_NO_TELEMETRY",
    "TELEMETRY_DISAPPEARANCE": "TELEMETRY_CONTINUITY_GAP",
    "WORKFLOW_REPETITION": "REPETITIVE_WORKFLOW",
    "METRIC_RISK_DIVERGENCE": "METRIC_RISK_DIVERGENCE",
}


def evaluate(ground_truth: DataFrame, findings: DataFrame) -> DataFrame:
    """Per scenario type: planted rows, rows whose entity has a finding of the expected
    type, and the verdict.

    A control (expected category NONE) passes when its entities, unless they also carry
    a planted scenario, have no repetitive-workflow finding. A scenario type without a
    detector of its own counts as found when its entity has any finding.
    """
    expected = F.coalesce("expected_detection_category", lookup(V.SCENARIO_CATEGORY, "scenario_type"))
    planted = ground_truth.where("entity_id is not null").select(
        "scenario_type", "entity_id", expected.alias("expected"),
    )
    wanted = planted.withColumn("finding_type", lookup(FINDING_OF_CATEGORY, "expected"))
    typed = findings.select("entity_id", "finding_type").distinct()
    by_type = typed.withColumn("typed_hit", F.lit(True))
    by_entity = typed.select("entity_id").distinct().withColumn("any_hit", F.lit(True))
    repetitive = typed.where("finding_type = 'REPETITIVE_WORKFLOW'").select("entity_id").withColumn("repetitive", F.lit(True))
    anomalous = planted.where("expected <> 'NONE'").select("entity_id").distinct().withColumn("also_planted", F.lit(True))
    no = F.lit(False)
    judged = (
        wanted.join(by_type, ["entity_id", "finding_type"], "left")
        .join(by_entity, "entity_id", "left")
        .join(repetitive, "entity_id", "left")
        .join(anomalous, "entity_id", "left")
        .select(
            "scenario_type",
            "expected",
            F.when(F.col("expected") == "NONE", F.coalesce("repetitive", no) & ~F.coalesce("also_planted", no))
            .when(F.col("finding_type").isNull(), F.coalesce("any_hit", no))
            .otherwise(F.coalesce("typed_hit", no))
            .alias("hit"),
        )
    )
    counted = judged.groupBy("scenario_type", "expected").agg(
        F.count("*").alias("planted"), F.count(F.when(F.col("hit"), 1)).alias("hits")
    )
    control = F.col("expected") == "NONE"
    return counted.select(
        "scenario_type", "expected", "planted", "hits",
        F.when(control & (F.col("hits") == 0), "CONTROL_CLEAN").when(control, "CONTROL_FLAGGED")
        .when(F.col("hits") > 0, "DETECTED").otherwise("MISSED").alias("verdict"),
    )
