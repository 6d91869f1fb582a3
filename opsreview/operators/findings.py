"""The findings of all detectors in one table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsreview import vocab as V
from opsreview.functions.expr import period_label
from opsreview.functions.pages import Pages
from opsreview.operators.confidence import (
    always,
    annotate,
    baseline_factors,
    period_factors,
    record_factors,
)

COLUMNS = (
    "finding_key", "analytic_id", "finding_type", "category", "entity_id", "period_label",
    "alert_severity", "summary", "confidence", "confidence_factors", "confidence_note",
    "evidence_count", "details",
)
MAX_PAGE = 500


def _present(col: str) -> Column:
    return F.when(F.col(col).isNotNull(), 1).otherwise(0)


def _unify(df: DataFrame, analytic: str, kind: Column, period: Column, severity: Column | None, details: tuple[str, ...]) -> DataFrame:
    pairs = [x for name in details for x in (F.lit(name), F.col(name).cast("string"))]
    return df.select(
        "finding_key",
        F.lit(analytic).alias("analytic_id"),
        kind.alias("finding_type"),
        F.lit(V.CATEGORY_OF_ANALYTIC[analytic]).alias("category"),
        "entity_id",
        F.coalesce(period, F.lit("unknown")).alias("period_label"),
        (F.lit(None).cast("string") if severity is None else severity).alias("alert_severity"),
        "summary", "confidence", "confidence_factors", "confidence_note", "evidence_count",
        F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("details"),
    )


def from_execution_gaps(gaps: DataFrame) -> DataFrame:
    direct = _present("alert_id") + F.col("n_related_alerts") + _present("investigation_id")
    annotated = annotate(
        gaps,
        record_factors(direct) + always("ABSENCE_BASED")
        + [(F.col("n_related_alerts") >= 3, "MULTIPLE_DIRECT_RECORDS")],
        direct,
        direct + _present("asset_id") + 1,
        F.lit(1),
    )
    return _unify(
        annotated, "EG-001", F.col("reason_code"),
        period_label(F.coalesce("observed_at", "window_start")), F.col("alert_severity"),
        ("gap_type", "reason_code", "alert_severity", "alert_id", "investigation_id", "asset_id",
         "recurrence_key", "expected_condition", "observed_condition"),
    )


def from_negative_space(gaps: DataFrame) -> DataFrame:
    n = F.coalesce("baseline_observation_count", F.lit(0))
    direct = n + _present("asset_id")
    annotated = annotate(
        gaps,
        record_factors(direct) + baseline_factors(n) + always("ABSENCE_BASED")
        + [((F.col("gap_type") == "TELEMETRY_DISAPPEARANCE") & (n < 3), "SMALL_BASELINE")],
        direct,
        direct + 1,
        F.lit(1),
    )
    return _unify(
        annotated, "NS-001", F.col("reason_code"), period_label("observation_start"), None,
        ("gap_type", "reason_code", "asset_id", "asset_criticality", "expected_telemetry", "silence_hours"),
    )


def from_anomalies(anomalies: DataFrame) -> DataFrame:
    one = F.lit(1)
    annotated = annotate(
        anomalies,
        record_factors(one) + baseline_factors(F.col("scored_observation_count"), adequate=15, large=20)
        + [
            (F.col("dropped_incomplete_count") > 0, "DROPPED_OBSERVATIONS"),
            (F.col("normalized_anomaly_score") < 0.55, "MINIMUM_THRESHOLD"),
        ],
        one,
        F.least(F.size("notable_features"), F.lit(2)) + 1,
        F.lit(0),
    )
    return _unify(
        annotated, "AN-001", F.col("decision"), period_label("period_start"), None,
        ("decision", "normalized_anomaly_score", "raw_anomaly_score"),
    )


def from_peers(deviations: DataFrame) -> DataFrame:
    one = F.lit(1)
    annotated = annotate(
        deviations,
        record_factors(one) + baseline_factors(F.col("peer_population_count"))
        + [(F.col("deviation_basis") == "ABSOLUTE_ZERO_MAD", "FRAGILE_BASELINE")],
        one,
        F.lit(2),
        F.lit(0),
    )
    return _unify(
        annotated, "PB-001", F.lit("PEER_DEVIATION"), period_label("period_start"), None,
        ("metric_name", "metric_unit", "entity_value", "peer_baseline", "peer_population_count",
         "deviation_measure", "deviation_basis", "direction"),
    )


def from_divergence(divergences: DataFrame) -> DataFrame:
    periods = F.col("supporting_period_count")
    annotated = annotate(
        divergences,
        record_factors(F.col("n_points")) + period_factors(periods)
        + [((periods >= 4) & (periods < 5), "MODERATE_BASELINE")],
        F.col("n_points"),
        F.col("n_values"),
        F.lit(0),
        native="confidence",
    )
    return _unify(
        annotated, "MRD-001", F.lit("METRIC_RISK_DIVERGENCE"), period_label("window_start"), None,
        ("headline_trend_score", "quality_trend_score", "supporting_period_count", "confidence"),
    )


def from_repetition(repetitions: DataFrame) -> DataFrame:
    n = F.col("matching_investigation_count")
    annotated = annotate(
        repetitions,
        record_factors(n)
        + [(n == 3, "MINIMUM_THRESHOLD"), (F.col("repetition_rate") < 0.25, "MODERATE_BASELINE")],
        n,
        n,
        F.lit(0),
        native="confidence",
    )
    kind = F.lit("REPETITIVE_WORKFLOW")
    return _unify(
        annotated.withColumn("finding_type", kind), "IF-REP-001", kind, F.col("period_label"), None,
        ("finding_type", "matching_investigation_count", "repetition_rate", "confidence"),
    )


def from_deviation(deviations: DataFrame) -> DataFrame:
    n, one = F.col("baseline_investigation_count"), F.lit(1)
    annotated = annotate(
        deviations,
        record_factors(one) + baseline_factors(n, adequate=3, large=8, fragile=n < 3)
        + [(n < 5, "FRAGILE_BASELINE")],
        one,
        F.lit(2),
        F.lit(0),
        native="confidence",
    )
    kind = F.lit("SEQUENCE_DEVIATION")
    return _unify(
        annotated.withColumn("finding_type", kind), "IF-DEV-002", kind, period_label("period_start"), None,
        ("finding_type", "normalized_distance", "baseline_investigation_count", "investigation_id", "confidence"),
    )


def from_incomplete(incomplete: DataFrame) -> DataFrame:
    two = F.lit(2)
    missing = F.size("missing_action_types")
    annotated = annotate(
        incomplete,
        record_factors(two) + always("ABSENCE_BASED") + [(F.col("action_count") <= 2, "MINIMUM_THRESHOLD")],
        two,
        two + missing,
        missing,
        native="confidence",
    )
    kind = F.lit("MISSING_EXPECTED_ACTION")
    return _unify(
        annotated.withColumn("finding_type", kind), "IF-MEA-003", kind, period_label("period_start"),
        F.col("alert_severity"),
        ("finding_type", "alert_severity", "alert_id", "investigation_id", "confidence"),
    )


#: Detector output name -> its projection into the common table.
UNIFIERS = {
    "execution_gap": from_execution_gaps,
    "negative_space": from_negative_space,
    "anomaly": from_anomalies,
    "peers": from_peers,
    "divergence": from_divergence,
    "repetitive": from_repetition,
    "deviating": from_deviation,
    "incomplete": from_incomplete,
}


def unified(detected: Mapping[str, DataFrame]) -> DataFrame:
    """All findings with confidence. Every part only projects, so the union adds no
    shuffle, and a filter on a constant column drops whole parts."""
    parts = [UNIFIERS[name](df) for name, df in detected.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def select_findings(
    findings: DataFrame,
    entity_id: str | None = None,
    analytic_id: str | None = None,
    category: str | None = None,
    period: str | None = None,
) -> DataFrame:
    """Findings that meet every given filter."""
    wanted = {"entity_id": entity_id, "analytic_id": analytic_id, "category": category, "period_label": period}
    for column, value in wanted.items():
        if value:
            findings = findings.where(F.col(column) == value)
    return findings


def page(findings: DataFrame, limit: int = 50, offset: int = 0, after: str | None = None) -> DataFrame:
    """One page in ``finding_key`` order. The total is ``findings.count()``.

    ``after``, the last key of the page before, keeps deep pages cheap: only ``limit`` rows
    are kept by any task, whereas an offset has all rows before the page kept too.
    """
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    if after is not None:
        findings = findings.where(F.col("finding_key") > after)
    return findings.orderBy("finding_key").offset(offset).limit(limit)


def pages(findings: DataFrame) -> Pages:
    """The findings by key, to be paged at any depth with their total, or on from a key."""
    return Pages(findings, ["finding_key"], "finding-pages")


def one(findings: DataFrame, finding_key: str) -> DataFrame:
    return findings.where(F.col("finding_key") == finding_key)


def count_by(findings: DataFrame, column: str, levels: tuple[str, ...]) -> DataFrame:
    """Counts per level of a vocabulary, 0 where a level does not occur."""
    spark = findings.sparkSession
    wanted = spark.createDataFrame([(x,) for x in levels], f"{column} string")
    counts = findings.groupBy(column).agg(F.count("*").alias("n"))
    return wanted.join(counts, column, "left").na.fill(0, ["n"])


def key_hash(findings: DataFrame) -> DataFrame:
    """One row that changes when the set of finding keys changes, in whatever order.

    Keys are reduced by mergeable aggregates, so no list of keys is ever built.
    """
    return findings.select("finding_key").distinct().agg(
        F.count("*").alias("n_keys"),
        F.bit_xor(F.xxhash64("finding_key")).alias("xor_hash"),
        F.sum(F.pmod(F.xxhash64("finding_key"), F.lit(1 << 31))).alias("sum_hash"),
    )




def multiset_hash(rows: DataFrame, *columns: str) -> DataFrame:
    """One row ``n_rows, sum_hash, xor_hash`` that is the same for the same rows in whatever order and partitions, repeated ones counted.

    Each row is hashed to 60 bits of a SHA-256 over its columns, with a null told from an empty text; the hashes are
    added and joined by exclusive or, so parts can be hashed apart and merged.
    """
    texts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    row_hash = F.conv(F.substring(F.sha2(F.concat(*texts), 256), 1, 15), 16, 10).cast("bigint")
    hashed = rows.select(row_hash.alias("h"))
    return hashed.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum_hash"), F.bit_xor("h").alias("xor_hash"))
