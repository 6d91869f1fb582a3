"""A full assessment: six analytics, confidence, evidence, review queue, summary."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsreview.config import AssessmentConfig
from opsreview.operators import (
    evidence,
    execution_gap,
    findings,
    forest,
    negative_space,
    peers,
    queue,
    sequences,
    trend,
)
from opsreview.operators.rollups import latest_metrics
from opsreview.session import write_each, write_through
from opsreview.sources.tables import Tables


@dataclass(frozen=True)
class Assessment:
    """Results of one run. ``detected`` holds the detectors' own columns."""

    tables: Tables
    config: AssessmentConfig
    records: DataFrame
    features: DataFrame
    detected: dict[str, DataFrame]
    findings: DataFrame

    @property
    def evidence(self) -> DataFrame:
        return evidence.all_refs(self.tables, self.detected, self.records, self.config.sequences)

    def queue(self, previous: DataFrame, run_at: datetime) -> DataFrame:
        return queue.merge(previous, queue.items(self.findings), run_at)

    def summary_with_queue(self, merged: DataFrame) -> DataFrame:
        """The summary and what the run did to the queue, given the merged queue."""
        done = queue.outcomes(merged).select(
            F.concat(F.lit("QUEUE_"), "outcome").alias("analytic_id"), F.col("n").alias("finding_count"), F.lit("OK").alias("status")
        )
        return self.summary.unionByName(done)

    @property
    def summary(self) -> DataFrame:
        """Entities, findings per analytic and in total, and the anomaly status."""
        per_analytic = self.findings.groupBy(
            F.regexp_replace("analytic_id", "^IF-.*", "IF").alias("analytic_id")
        ).agg(F.count("*").alias("finding_count"))
        spark = self.findings.sparkSession
        wanted = spark.createDataFrame([(a,) for a in ("EG-001", "NS-001", "AN-001", "PB-001", "MRD-001", "IF")], "analytic_id string")
        anomaly_status = forest.status(self.features, self.config.anomaly).select("status").scalar()
        analytics = wanted.join(per_analytic, "analytic_id", "left").select(
            "analytic_id",
            F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
            F.when(F.col("analytic_id") == "AN-001", anomaly_status).otherwise("OK").alias("status"),
        )
        totals = self.findings.agg(F.count("*").alias("finding_count")).select(
            F.lit("TOTAL").alias("analytic_id"), "finding_count", F.lit("OK").alias("status")
        )
        entities = self.tables.entities.agg(F.count("*").alias("finding_count")).select(
            F.lit("ENTITIES").alias("analytic_id"), "finding_count", F.lit("OK").alias("status")
        )
        return analytics.unionByName(totals).unionByName(entities)


def detect_all(tables: Tables, config: AssessmentConfig, records: DataFrame, features: DataFrame) -> dict[str, DataFrame]:
    return {
        "execution_gap": execution_gap.detect(tables, config.execution_gap),
        "negative_space": negative_space.detect(tables, config.negative_space),
        "anomaly": forest.detect(features, config.anomaly),
        "peers": peers.detect(tables, config.peers),
        "divergence": trend.detect(tables, config.divergence),
        "repetitive": sequences.repetitive(records, config.sequences),
        "deviating": sequences.deviating(records, config.sequences),
        "incomplete": sequences.incomplete(records, config.sequences),
    }


def assess(
    tables: Tables,
    config: AssessmentConfig = AssessmentConfig(),
    entity_ids: list[str] | DataFrame | None = None,
) -> Assessment:
    """Run the analytics over the tables, for all entities or the given ones.

    The KPI table, the investigation records, the features and each detector's output are
    written once and shared; so is the findings table, the product of the run.
    """
    scoped = tables.scoped(entity_ids)
    kpis = write_through(latest_metrics(scoped.performance_metrics), "kpis")
    scoped = scoped.replace(performance_metrics=kpis)
    records = sequences.investigation_records(scoped, config.sequences)
    features = forest.model_rows(scoped)
    detected = write_each(detect_all(scoped, config, records, features))
    return Assessment(
        scoped, config, records, features, detected, write_through(findings.unified(detected), "findings")
    )
