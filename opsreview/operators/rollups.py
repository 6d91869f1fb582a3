"""Reporting periods, KPI rollup and the feature table of the anomaly model."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsreview import vocab as V
from opsreview.functions.expr import lookup, rate, round_half_even, seconds_between
from opsreview.sources.tables import Tables

PERIOD = ("entity_id", "period_start", "period_end")


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """One KPI row per entity and period start: the highest metric id wins."""
    newest = metrics.groupBy("entity_id", "period_start").agg(
        F.max_by(F.struct(*metrics.columns), "metric_id").alias("row")
    )
    return newest.select("row.*")


def reporting_periods(metrics: DataFrame) -> DataFrame:
    """The period grid: one row per entity and period start."""
    return metrics.groupBy("entity_id", "period_start").agg(
        F.max_by("period_end", "metric_id").alias("period_end")
    )


def _month(col: str) -> F.Column:
    return F.trunc(F.col(col), "month")


def with_periods(records: DataFrame, periods: DataFrame, at: str) -> DataFrame:
    """Add ``periods``: the half-open periods of the entity that hold ``at``, in order.

    Periods are indexed by the calendar months they touch, so the range condition
    becomes an equality on (entity, month) and a record meets only the few periods
    of its own month. The list per key is bounded by the calendar. Records outside
    every period are dropped.
    """
    months = F.explode(
        F.sequence(
            _month("period_start"),
            F.trunc(F.col("period_end") - F.expr("interval 1 microsecond"), "month"),
            F.expr("interval 1 month"),
        )
    )
    index = (
        periods.where("period_end > period_start")
        .select("entity_id", months.alias("month"), F.struct("period_start", "period_end").alias("p"))
        .groupBy("entity_id", "month")
        .agg(F.array_sort(F.collect_list("p")).alias("candidates"))
    )

    def holds(p: F.Column) -> F.Column:
        return (p["period_start"] <= F.col(at)) & (F.col(at) < p["period_end"])

    return (
        records.withColumn("month", _month(at))
        .join(index, ["entity_id", "month"])
        .withColumn("periods", F.filter("candidates", holds))
        .where(F.size("periods") > 0)
        .drop("month", "candidates")
    )


def in_every_period(records: DataFrame, periods: DataFrame, at: str) -> DataFrame:
    """One row per record and matching period (overlapping periods all count)."""
    return (
        with_periods(records, periods, at)
        .withColumn("p", F.explode("periods"))
        .select(*records.columns, "p.period_start", "p.period_end")
    )


def in_first_period(records: DataFrame, periods: DataFrame, at: str) -> DataFrame:
    """Each record with its earliest matching period."""
    return (
        with_periods(records, periods, at)
        .withColumn("p", F.col("periods")[0])
        .select(*records.columns, "p.period_start", "p.period_end")
    )


def investigation_facts(tables: Tables) -> DataFrame:
    """Per investigation: action count, workflow steps seen, escalated, remediated.

    The three child tables are stacked and grouped once, with map-side partial
    aggregation, instead of being joined one after the other.
    """
    no, yes = F.lit(False), F.lit(True)
    actions = tables.investigation_actions.select(
        "investigation_id",
        F.lit(1).alias("action"),
        (F.col("action_type") == "VALIDATE").alias("validated"),
        (F.col("action_type") == "CLOSE").alias("closed_out"),
        no.alias("escalated"),
        no.alias("remediated"),
    )

    def link(df: DataFrame, escalated: F.Column, remediated: F.Column) -> DataFrame:
        return df.where(F.col("investigation_id").isNotNull()).select(
            "investigation_id", F.lit(0).alias("action"), no.alias("validated"),
            no.alias("closed_out"), escalated.alias("escalated"), remediated.alias("remediated"),
        )

    stacked = (
        actions.unionByName(link(tables.escalations, yes, no))
        .unionByName(link(tables.remediations.where(F.col("status") == "COMPLETED"), no, yes))
    )
    return stacked.groupBy("investigation_id").agg(
        F.sum("action").alias("n_actions"),
        *[F.bool_or(c).alias(c) for c in ("validated", "closed_out", "escalated", "remediated")],
    )


def remediated_alerts(tables: Tables) -> DataFrame:
    """Distinct ids of alerts with a COMPLETED remediation, by either link."""
    done = tables.remediations.where(F.col("status") == "COMPLETED")
    by_investigation = (
        done.where(F.col("investigation_id").isNotNull())
        .select("investigation_id")
        .join(tables.investigations.select("investigation_id", "alert_id"), "investigation_id")
        .select("alert_id")
    )
    return done.where(F.col("alert_id").isNotNull()).select("alert_id").union(by_investigation).distinct()


def kpi_rollup(tables: Tables, periods: DataFrame) -> DataFrame:
    """The eight KPIs per entity and period.

    Alerts count in the period of their creation, investigations in the period of
    their alert. Ratios over nothing take their neutral default.
    """
    facts = investigation_facts(tables)
    investigations = (
        tables.investigations.select("investigation_id", "alert_id", F.col("status").alias("inv_status"), "duration_seconds", "evidence_count")
        .join(facts, "investigation_id", "left")
        .withColumn("has_inv", F.lit(True))
    )
    alerts = in_every_period(
        tables.alerts.select("alert_id", "entity_id", "severity", "created_at", "acknowledged_at", "recurrence_key", "is_true_positive"),
        periods,
        "created_at",
    ).join(investigations, "alert_id", "left")

    def n(condition: F.Column) -> F.Column:
        return F.count(F.when(condition, 1))

    closed = F.col("inv_status") == "CLOSED"
    acked = F.col("acknowledged_at").isNotNull()
    in_time = seconds_between("created_at", "acknowledged_at") / 60.0 <= lookup(V.SLA_MINUTES, "severity")
    confirmed = F.col("is_true_positive").eqNullSafe(True)
    # min(1, evidence / expected) in whole parts of a common denominator, so that the
    # sum is exact and does not depend on the order of rows.
    parts = math.lcm(*V.EXPECTED_EVIDENCE.values())
    share = {severity: parts // n for severity, n in V.EXPECTED_EVIDENCE.items()}
    evidence = F.least(F.col("evidence_count"), lookup(V.EXPECTED_EVIDENCE, "severity")) * lookup(share, "severity")
    has_key = F.coalesce(F.col("recurrence_key"), F.lit("")) != ""
    counted = alerts.groupBy(*PERIOD).agg(
        F.count("*").alias("alerts"),
        n(F.col("has_inv")).alias("investigations"),
        n(closed).alias("closed"),
        F.sum(F.when(closed, F.col("duration_seconds"))).alias("closed_seconds"),
        n(acked).alias("acked"),
        n(acked & in_time).alias("in_time"),
        n(F.col("has_inv") & F.col("escalated")).alias("escalated"),
        n(closed & F.col("validated") & F.col("closed_out")).alias("full_workflow"),
        n(has_key).alias("recurring"),
        n(confirmed).alias("confirmed"),
        n(confirmed & F.col("has_inv") & F.col("remediated")).alias("remediated"),
        F.sum(F.when(closed, evidence)).alias("evidence"),
    )
    measured = periods.select(*PERIOD).join(counted, list(PERIOD), "left").na.fill(0)

    def kpi(name: str, top: F.Column, bottom: str, default: float) -> F.Column:
        return round_half_even(rate(top, F.col(bottom), default), 4).alias(name)

    c = F.col
    return measured.select(
        *PERIOD,
        kpi("mttr_hours", c("closed_seconds") / 3600.0, "closed", 0.0),
        kpi("closure_rate", c("closed"), "investigations", 1.0),
        kpi("sla_compliance", c("in_time"), "acked", 1.0),
        kpi("escalation_rate", c("escalated"), "investigations", 0.0),
        kpi("investigation_completeness", c("full_workflow"), "closed", 1.0),
        kpi("recurrence_rate", c("recurring"), "alerts", 0.0),
        kpi("remediation_rate", c("remediated"), "confirmed", 1.0),
        kpi("evidence_completeness", c("evidence") / float(parts), "closed", 1.0),
    )


def period_features(tables: Tables) -> DataFrame:
    """Nine model features and two context features per entity and period.

    Unlike the KPIs, investigations count in the period they started in. A ratio
    over nothing is NULL, which later keeps the row out of the model.
    """
    periods = reporting_periods(tables.performance_metrics)

    def n(condition: F.Column) -> F.Column:
        return F.count(F.when(condition, 1))

    resolved = F.col("is_true_positive").isNotNull()
    confirmed = F.col("is_true_positive").eqNullSafe(True)
    alerts = (
        in_every_period(
            tables.alerts.select("alert_id", "entity_id", "severity", "created_at", "is_true_positive"),
            periods,
            "created_at",
        )
        .join(remediated_alerts(tables).withColumn("remediated", F.lit(True)), "alert_id", "left")
        .groupBy(*PERIOD)
        .agg(
            F.count("*").alias("alerts"),
            n(F.col("severity").isin("HIGH", "CRITICAL")).alias("severe"),
            n(resolved).alias("resolved"),
            n(confirmed).alias("confirmed"),
            n(confirmed & F.col("remediated")).alias("remediated"),
        )
    )
    closed = F.col("status") == "CLOSED"
    investigations = (
        in_every_period(
            tables.investigations.select("investigation_id", "entity_id", "status", "started_at", "duration_seconds", "evidence_count"),
            periods,
            "started_at",
        )
        .join(investigation_facts(tables).select("investigation_id", "n_actions", "escalated"), "investigation_id", "left")
        .groupBy(*PERIOD)
        .agg(
            F.count("*").alias("investigations"),
            n(closed).alias("closed"),
            n(F.col("escalated")).alias("escalated"),
            F.sum(F.when(closed, F.col("duration_seconds"))).alias("seconds"),
            n(closed & F.col("duration_seconds").isNotNull()).alias("timed"),
            F.coalesce(F.sum("n_actions"), F.lit(0)).alias("actions"),
            F.sum("evidence_count").alias("evidence"),
        )
    )
    c = F.col
    counted = (
        periods.join(alerts, list(PERIOD), "left")
        .join(investigations, list(PERIOD), "left")
        .na.fill(0)
        .join(tables.entities.select("entity_id", "asset_count_estimate"), "entity_id")
    )
    return counted.select(
        *PERIOD,
        rate(c("alerts"), F.greatest(c("asset_count_estimate"), F.lit(1))).alias("alerts_per_asset"),
        rate(c("severe"), c("alerts")).alias("crit_high_rate"),
        rate(c("confirmed"), c("resolved")).alias("tp_rate"),
        rate(c("closed"), c("investigations")).alias("closure_rate"),
        rate(c("investigations"), c("alerts")).alias("inv_coverage"),
        rate(c("escalated"), c("investigations")).alias("esc_rate"),
        (rate(c("seconds"), c("timed")) / 3600.0).alias("mean_inv_dur_h"),
        rate(c("actions"), c("investigations")).alias("mean_actions"),
        rate(c("evidence"), c("investigations")).alias("mean_evidence"),
        c("alerts").cast("double").alias("alert_count"),
        rate(c("remediated"), c("confirmed")).alias("rem_rate"),
    )
