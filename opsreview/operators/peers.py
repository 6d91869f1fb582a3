"""Reported KPIs that differ from those of comparable entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsreview import vocab as V
from opsreview.config import PeerConfig
from opsreview.functions.expr import lookup, period_label
from opsreview.functions.ordered import others_median
from opsreview.operators.rollups import latest_metrics
from opsreview.session import write_through
from opsreview.sources.tables import Tables


def _grouped(tables: Tables, config: PeerConfig) -> DataFrame:
    groups = tables.entities.select("entity_id", F.col(config.peer_dimension).cast("string").alias("peer_group"))
    return latest_metrics(tables.performance_metrics).join(groups, "entity_id")


def peer_status(tables: Tables, config: PeerConfig = PeerConfig()) -> DataFrame:
    """Entity-periods that could not be compared for want of peers."""
    rows = _grouped(tables, config).select("entity_id", "period_start", "period_end", "peer_group")
    present = rows.groupBy("peer_group", "period_start").agg((F.count("*") - 1).alias("peer_population_count"))
    return (
        rows.join(
            present.where(F.col("peer_population_count") < config.peer_min_count),
            ["peer_group", "period_start"],
        )
        .select(
            F.lit("INSUFFICIENT_PEERS").alias("status"),
            "entity_id", "period_start", "period_end",
            F.lit(config.peer_dimension).alias("peer_dimension"),
            "peer_group", "peer_population_count",
        )
    )


def detect(tables: Tables, config: PeerConfig = PeerConfig()) -> DataFrame:
    """PB-001: a KPI far from the median of the *other* members of its peer group.

    Distance is measured in scaled median absolute deviations of the peers, or
    against an absolute floor when the peers do not vary. Leaving the entity itself
    out is done by order statistics, twice: on the values and then on the distances
    to each of the (at most three) medians a group can have. No entity is paired
    with its peers, so the cost grows with the number of rows, not its square.
    """
    cell = ["peer_group", "period_start", "metric_name"]
    long = write_through(
        _grouped(tables, config).select(
            "entity_id", "period_start", "period_end", "peer_group",
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(k).alias("metric_name"), F.col(k).cast("double").alias("entity_value"))
                        for k in V.KPI_NAMES
                    ]
                )
            ).alias("kpi"),
        ).select("entity_id", "period_start", "period_end", "peer_group", "kpi.*"),
        "peer-values",
    )
    centred = write_through(
        others_median(long, cell, "entity_value", "peer_baseline", "peer-median").where(
            F.col("others") >= config.peer_min_count
        ),
        "peer-centres",
    )
    centres = centred.select(*cell, "peer_baseline").distinct()
    distances = long.join(centres, cell).withColumn(
        "distance", F.abs(F.col("entity_value") - F.col("peer_baseline"))
    )
    spread = others_median(distances, [*cell, "peer_baseline"], "distance", "mad", "peer-spread")
    judged = centred.join(
        spread.select("entity_id", *cell, "peer_baseline", "distance", "mad"),
        ["entity_id", *cell, "peer_baseline"],
    ).withColumn("scaled_mad", F.lit(float(config.mad_scale_factor)) * F.col("mad"))

    floors = {name: float(config.abs_threshold_overrides.get(name, floor)) for name, _, floor in V.KPIS}
    flat = F.col("scaled_mad") == 0.0
    ratio = F.try_divide("distance", "scaled_mad")
    above = F.col("entity_value") > F.col("peer_baseline")
    return (
        judged.where(
            F.when(flat, F.col("distance") >= lookup(floors, "metric_name")).otherwise(
                ratio >= F.lit(float(config.mad_threshold))
            )
        )
        .select(
            F.concat_ws(":", F.lit("PB-001"), "entity_id", period_label("period_start"), "metric_name").alias("finding_key"),
            "entity_id", "period_start", "period_end", "metric_name",
            lookup({name: unit for name, unit, _ in V.KPIS}, "metric_name").alias("metric_unit"),
            "entity_value", "peer_baseline",
            F.col("others").alias("peer_population_count"),
            "peer_group",
            F.when(flat, F.col("distance")).otherwise(ratio).alias("deviation_measure"),
            F.when(flat, "ABSOLUTE_ZERO_MAD").otherwise("ROBUST_MAD").alias("deviation_basis"),
            F.when(above, "ABOVE").otherwise("BELOW").alias("direction"),
        )
        .withColumn(
            "summary",
            F.format_string(
                "%s of entity %s was %.4g in %s, %s the median %.4g of %d peers. This compares reported values only.",
                "metric_name", "entity_id", "entity_value", period_label("period_start"),
                F.lower("direction"), "peer_baseline", "peer_population_count",
            ),
        )
    )
