"""References from findings to the records behind them, one row per reference.

A finding may rest on any number of records, so references stay rows and are never
gathered into a list. Reference ids are unique per finding as long as primary keys
are (the import checks that); :func:`unique_refs` removes repeats otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsreview.functions.expr import period_label
from opsreview.operators import execution_gap, negative_space, sequences, trend
from opsreview.operators.rollups import latest_metrics
from opsreview.sources.tables import Tables
from opsreview.vocab import KPI_NAMES

COLUMNS = ("finding_key", "analytic_id", "source_type", "source_id", "role", "period_label", "reason")


def _ref(kind: str, source_id: Column, role: Column | str, reason: Column | str) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        F.lit(kind).alias("source_type"),
        source_id.alias("source_id"),
        text(role).alias("role"),
        text(reason).alias("reason"),
    )


def _spread(df: DataFrame, analytic: str, period: Column, *refs: Column) -> DataFrame:
    """One row per reference of each finding; references with a NULL id do not exist."""
    return df.select(
        "finding_key",
        F.lit(analytic).alias("analytic_id"),
        period.alias("period_label"),
        F.explode(F.array(*refs)).alias("ref"),
    ).where("ref.source_id is not null").select(
        "finding_key", "analytic_id", "ref.source_type", "ref.source_id", "ref.role", "period_label", "ref.reason"
    )


def execution_gap_refs(tables: Tables, gaps: DataFrame) -> DataFrame:
    c = F.col
    scope = F.concat(
        F.lit("entity:"), c("entity_id"),
        F.coalesce(F.concat(F.lit("|alert:"), c("alert_id")), F.lit("")),
        F.coalesce(F.concat(F.lit("|recurrence_key:"), c("recurrence_key")), F.lit("")),
    )
    lacking = F.lower(F.regexp_replace("gap_type", "_GAP$", ""))
    own = _spread(
        gaps, "EG-001", period_label(F.coalesce("observed_at", "window_start")),
        _ref("ALERT", c("alert_id"), "triggering_alert", F.format_string("The %s alert of the finding.", "alert_severity")),
        _ref("INVESTIGATION", c("investigation_id"), "associated_investigation", "The investigation of the alert."),
        _ref("ASSET", c("asset_id"), "affected_asset", "The asset of the alert."),
        _ref("ABSENCE", F.concat(F.lit("missing_"), lacking, F.lit("|"), scope),
             F.concat(F.lit("missing_expected_"), lacking), c("expected_condition")),
    )
    members = _spread(
        execution_gap.recurrence_members(tables, gaps), "EG-001", period_label("window_start"),
        _ref("ALERT", c("alert_id"), "related_recurring_alert",
             F.concat(F.lit("An alert with recurrence key "), c("recurrence_key"), F.lit("."))),
    )
    return own.unionByName(members)


def negative_space_refs(tables: Tables, gaps: DataFrame) -> DataFrame:
    c = F.col
    period = period_label("observation_start")
    scope = F.concat(F.lit("entity:"), c("entity_id"), F.lit("|asset:"), c("asset_id"))
    never = c("gap_type") == "MONITORING_GAP"
    own = _spread(
        gaps, "NS-001", period,
        _ref("ASSET", c("asset_id"), "monitored_asset",
             F.format_string("The monitored asset (criticality %s).", "asset_criticality")),
        _ref(
            "ABSENCE",
            F.concat(F.when(never, "missing_telemetry|").otherwise("telemetry_gap|"), scope),
            F.when(never, "missing_expected_telemetry").otherwise("telemetry_continuity_gap"),
            c("expected_evidence"),
        ),
    )
    members = _spread(
        negative_space.telemetry_members(tables, gaps), "NS-001", period,
        _ref("TELEMETRY_RECORD", c("telemetry_id"), "last_observed_telemetry", "Telemetry from before the silence."),
    )
    return own.unionByName(members)


def anomaly_refs(anomalies: DataFrame) -> DataFrame:
    c = F.col
    period = period_label("period_start")
    subject = F.concat_ws(":", c("entity_id"), period)
    kind = "ENTITY_PERIOD_OBSERVATION"

    def notable(i: int) -> Column:
        feature = F.get(c("notable_features"), i)
        return _ref(
            kind, F.concat(subject, F.lit(":feature:"), feature["name"]), "notable_feature",
            F.format_string("%s is %.3g; the median is %.3g.", feature["name"], feature["value"], feature["population_median"]),
        )

    return _spread(
        anomalies, "AN-001", period,
        _ref(kind, subject, "anomalous_observation", F.format_string("Signal %.2f.", "normalized_anomaly_score")),
        notable(0),
        notable(1),
    )


def peer_refs(deviations: DataFrame) -> DataFrame:
    c = F.col
    period = period_label("period_start")
    return _spread(
        deviations, "PB-001", period,
        _ref("PERFORMANCE_METRIC", F.concat_ws(":", c("entity_id"), period, c("metric_name")),
             "subject_metric_observation", F.format_string("The reported value %.4g.", "entity_value")),
        _ref(
            "PEER_BASELINE",
            F.concat(F.lit("peer_group:"), c("peer_group"), F.lit(":period:"), period, F.lit(":metric:"), c("metric_name")),
            "peer_baseline",
            F.format_string("The median %.4g of %d peers.", "peer_baseline", "peer_population_count"),
        ),
    )


def divergence_refs(tables: Tables, divergences: DataFrame) -> DataFrame:
    c = F.col
    points = trend.snapshots(tables).join(divergences.select("entity_id", "finding_key"), "entity_id")
    role = F.when(c("metric_group") == "HEADLINE", "headline_kpi").otherwise("quality_indicator")
    refs = _spread(
        points, "MRD-001", c("period_label"),
        _ref("PERFORMANCE_METRIC", F.concat_ws(":", "entity_id", "period_label", "metric_name"), role,
             F.format_string("%s was %.4g.", "metric_name", "value")),
    )
    return unique_refs(refs)


def repetition_refs(records: DataFrame, repetitions: DataFrame, config: sequences.SequenceConfig) -> DataFrame:
    return _spread(
        sequences.repetition_members(records, repetitions, config), "IF-REP-001", F.col("period_label"),
        _ref("INVESTIGATION", F.col("investigation_id"), "repeated_pattern_investigation",
             "An investigation with the repeated action sequence."),
    )


def deviation_refs(deviations: DataFrame) -> DataFrame:
    c = F.col
    return _spread(
        deviations, "IF-DEV-002", period_label("period_start"),
        _ref("INVESTIGATION", c("investigation_id"), "deviating_investigation",
             F.format_string("Its action sequence is %.2f away from the usual one.", "normalized_distance")),
        _ref(
            "PEER_BASELINE",
            F.concat(F.lit("entity_baseline:"), c("entity_id"), F.lit(":n="), c("baseline_investigation_count").cast("string")),
            "entity_baseline_fingerprint",
            F.format_string("The usual sequence, seen %d times before.", "baseline_investigation_count"),
        ),
    )


def incomplete_refs(incomplete: DataFrame) -> DataFrame:
    c = F.col
    period = period_label("period_start")
    own = _spread(
        incomplete, "IF-MEA-003", period,
        _ref("INVESTIGATION", c("investigation_id"), "incomplete_investigation", "The closed investigation."),
        _ref("ALERT", c("alert_id"), "associated_high_crit_alert",
             F.format_string("Its %s alert.", "alert_severity")),
    )
    lacking = _spread(
        incomplete.withColumn("action", F.explode("missing_action_types")), "IF-MEA-003", period,
        _ref("ABSENCE", F.concat(F.lit("missing_action|inv:"), c("investigation_id"), F.lit("|action:"), c("action")),
             "missing_expected_action", F.concat(F.lit("No action of type "), c("action"), F.lit("."))),
    )
    return own.unionByName(lacking)


def unique_refs(refs: DataFrame) -> DataFrame:
    """One row per (finding, source type, source id); the smallest (role, reason) stays.

    Grouping by the full reference spreads a finding with many references evenly.
    """
    key = ("finding_key", "analytic_id", "source_type", "source_id")
    rest = [c for c in COLUMNS if c not in key]
    return (
        refs.groupBy(*key)
        .agg(F.min(F.struct("role", "reason", "period_label")).alias("kept"))
        .select(*key, *[F.col(f"kept.{c}").alias(c) for c in rest])
        .select(*COLUMNS)
    )


def all_refs(
    tables: Tables,
    detected: Mapping[str, DataFrame],
    records: DataFrame | None = None,
    config: sequences.SequenceConfig = sequences.SequenceConfig(),
) -> DataFrame:
    """References of every given detector output. Sort by (finding, type, id) to list them."""
    make = {
        "execution_gap": lambda d: execution_gap_refs(tables, d),
        "negative_space": lambda d: negative_space_refs(tables, d),
        "anomaly": anomaly_refs,
        "peers": peer_refs,
        "divergence": lambda d: divergence_refs(tables, d),
        "repetitive": lambda d: repetition_refs(records, d, config),
        "deviating": deviation_refs,
        "incomplete": incomplete_refs,
    }
    parts = [make[name](df) for name, df in detected.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def unsupported_refs(tables: Tables, refs: DataFrame) -> DataFrame:
    """References to records that do not exist. Empty for sound results."""
    ids = {
        "ALERT": tables.alerts.select(F.col("alert_id").alias("source_id")),
        "INVESTIGATION": tables.investigations.select(F.col("investigation_id").alias("source_id")),
        "ASSET": tables.assets.select(F.col("asset_id").alias("source_id")),
        "TELEMETRY_RECORD": tables.telemetry.select(F.col("telemetry_id").alias("source_id")),
        "PERFORMANCE_METRIC": latest_metrics(tables.performance_metrics).select(
            F.explode(
                F.transform(
                    F.array(*[F.lit(k) for k in KPI_NAMES]),
                    lambda k: F.concat_ws(":", F.col("entity_id"), period_label("period_start"), k),
                )
            ).alias("source_id")
        ),
    }
    known = None
    for kind, id_column in ids.items():
        part = id_column.select(F.lit(kind).alias("source_type"), "source_id")
        known = part if known is None else known.unionByName(part)
    return (
        refs.where(F.col("source_type").isin(*ids))
        .join(known, ["source_type", "source_id"], "left_anti")
        .select(*COLUMNS)
    )
