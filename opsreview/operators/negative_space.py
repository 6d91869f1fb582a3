"""Telemetry that should exist and does not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsreview.config import NegativeSpaceConfig
from opsreview.functions.expr import hours_between, round_half_even, severity_at_least
from opsreview.sources.tables import Tables

COLUMNS = (
    "finding_key", "rule_id", "gap_type", "reason_code", "entity_id", "asset_id",
    "observation_start", "observation_end", "last_evidence_at", "asset_criticality",
    "expected_telemetry", "baseline_observation_count", "silence_hours", "summary",
    "expected_evidence", "observed_evidence",
)


def _monitored(tables: Tables, config: NegativeSpaceConfig) -> DataFrame:
    assets = tables.assets.select(
        "asset_id", "entity_id", "criticality", "monitoring_expected", "expected_telemetry"
    )
    return assets.where("monitoring_expected") if config.monitoring_require_expected_flag else assets


def silent_assets(tables: Tables, config: NegativeSpaceConfig) -> DataFrame:
    """NS-001: critical monitored assets without one telemetry record, in entities
    observed long enough for that to mean something."""
    window = tables.entities.select("entity_id", "data_period_start", "data_period_end").where(
        hours_between("data_period_start", "data_period_end")
        >= F.lit(float(config.monitoring_min_observation_hours))
    )
    gaps = (
        _monitored(tables, config)
        .where(severity_at_least("criticality", config.monitoring_min_criticality))
        .join(tables.telemetry.select("asset_id"), "asset_id", "left_anti")
        .join(window, "entity_id")
    )
    wanted = F.coalesce(F.concat(F.lit(" of category "), "expected_telemetry"), F.lit(""))
    return gaps.select(
        F.concat(F.lit("NS-001:"), "asset_id").alias("finding_key"),
        F.lit("NS-001").alias("rule_id"),
        F.lit("MONITORING_GAP").alias("gap_type"),
        F.lit("CRITICAL_ASSET_NO_TELEMETRY").alias("reason_code"),
        "entity_id",
        "asset_id",
        F.col("data_period_start").alias("observation_start"),
        F.col("data_period_end").alias("observation_end"),
        F.lit(None).cast(tables.telemetry.schema["period_end"].dataType).alias("last_evidence_at"),
        F.col("criticality").alias("asset_criticality"),
        "expected_telemetry",
        F.lit(None).cast("bigint").alias("baseline_observation_count"),
        F.lit(None).cast("double").alias("silence_hours"),
        F.format_string(
            "%s asset %s is to be monitored; the observed window holds no telemetry of it.",
            "criticality", "asset_id",
        ).alias("summary"),
        F.concat(
            F.lit("At least one telemetry record"), wanted,
            F.format_string(" for a monitored %s asset.", "criticality"),
        ).alias("expected_evidence"),
        F.lit("No telemetry record names the asset. The cause is not known from the data.").alias("observed_evidence"),
    )


def vanished_telemetry(tables: Tables, config: NegativeSpaceConfig) -> DataFrame:
    """NS-002: assets that reported before and then fell silent up to the end of the data."""
    seen = tables.telemetry.groupBy("asset_id").agg(
        F.count("*").alias("baseline_observation_count"),
        F.max("period_end").alias("last_evidence_at"),
    )
    silence = hours_between("last_evidence_at", "data_period_end")
    gaps = (
        _monitored(tables, config)
        .join(
            seen.where(F.col("baseline_observation_count") >= config.disappearance_min_baseline_periods),
            "asset_id",
        )
        .join(tables.entities.select("entity_id", "data_period_end"), "entity_id")
        .where(
            (F.col("last_evidence_at") < F.col("data_period_end"))
            & (silence >= F.lit(float(config.telemetry_gap_threshold_hours)))
        )
    )
    n = F.col("baseline_observation_count")
    return gaps.select(
        F.concat(F.lit("NS-002:"), "asset_id").alias("finding_key"),
        F.lit("NS-002").alias("rule_id"),
        F.lit("TELEMETRY_DISAPPEARANCE").alias("gap_type"),
        F.lit("TELEMETRY_CONTINUITY_GAP").alias("reason_code"),
        "entity_id",
        "asset_id",
        F.col("last_evidence_at").alias("observation_start"),
        F.col("data_period_end").alias("observation_end"),
        "last_evidence_at",
        F.col("criticality").alias("asset_criticality"),
        "expected_telemetry",
        "baseline_observation_count",
        round_half_even(silence, 3).alias("silence_hours"),
        F.format_string(
            "Asset %s reported in %d periods and then no more until the end of the data.", "asset_id", n
        ).alias("summary"),
        F.format_string("Further telemetry after %d earlier records.", n).alias("expected_evidence"),
        F.format_string(
            "No telemetry for about %.0fh at the end of the data. The cause is not known from the data.", silence
        ).alias("observed_evidence"),
    )


def telemetry_members(tables: Tables, findings: DataFrame) -> DataFrame:
    """The telemetry records behind each NS-002 finding, one row per record."""
    gone = findings.where("rule_id = 'NS-002'").select("asset_id", "finding_key", "observation_start")
    return tables.telemetry.select("asset_id", "telemetry_id").join(gone, "asset_id")


RULES: dict[str, Callable[[Tables, NegativeSpaceConfig], DataFrame]] = {
    "NS-001": silent_assets,
    "NS-002": vanished_telemetry,
}


def detect(
    tables: Tables, config: NegativeSpaceConfig = NegativeSpaceConfig(), enabled: tuple[str, ...] = tuple(RULES)
) -> DataFrame:
    """All findings of the enabled rules."""
    parts = [RULES[rule](tables, config) for rule in enabled]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
