"""Headline KPIs that improve while quality KPIs get worse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsreview import vocab as V
from opsreview.config import DivergenceConfig
from opsreview.functions.expr import clamp_unit, period_label
from opsreview.operators.rollups import latest_metrics
from opsreview.sources.tables import Tables


def observed_metrics(tables: Tables) -> DataFrame:
    """KPI rows whose period starts before the entity's data end."""
    horizon = tables.entities.select("entity_id", "data_period_end")
    return (
        latest_metrics(tables.performance_metrics)
        .join(horizon, "entity_id")
        .where(F.col("data_period_end").isNull() | (F.col("period_start") < F.col("data_period_end")))
        .drop("data_period_end")
    )


def _long(metrics: DataFrame) -> DataFrame:
    points = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric_name"),
                F.lit(group).alias("metric_group"),
                F.lit(up).alias("higher_is_better"),
                F.col(name).cast("double").alias("value"),
            )
            for name, group, up in V.TREND_KPIS
        ]
    )
    return metrics.select(
        "entity_id", "period_start", "period_end", F.explode(points).alias("m")
    ).select("entity_id", "period_start", "period_end", "m.*")


def trend_scores(tables: Tables) -> DataFrame:
    """Trend of each KPI per entity, in [-1, 1]; positive means it got better.

    The least-squares change over the whole series, relative to its range. With two
    points it is the relative change; with fewer it is NULL. After the one-row-per-
    period rule a series is as long as the calendar, so the window is small.
    """
    points = _long(observed_metrics(tables)).where(F.col("value").isNotNull())
    better = F.when(F.col("higher_is_better"), F.col("value")).otherwise(-F.col("value"))
    series = points.withColumn("y", better).withColumn(
        "x",
        (F.row_number().over(W.partitionBy("entity_id", "metric_name").orderBy("period_start")) - 1).cast("double"),
    )
    fitted = series.groupBy("entity_id", "metric_name", "metric_group", "higher_is_better").agg(
        F.count("*").alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        (F.max("y") - F.min("y")).alias("spread"),
        F.min_by("y", "x").alias("first"),
        F.max_by("y", "x").alias("last"),
    )
    n = F.col("n")
    relative = (F.col("last") - F.col("first")) / F.greatest(F.abs("first"), F.abs("last"), F.lit(1e-9))
    score = (
        F.when(n < 2, F.lit(None).cast("double"))
        .when(n == 2, clamp_unit(relative))
        .when(F.col("spread") == 0.0, F.lit(0.0))
        .otherwise(clamp_unit(F.col("slope") * (n - 1) / F.nullif(F.col("spread"), F.lit(0.0))))
    )
    return fitted.select(
        "entity_id", "metric_name", "metric_group", "higher_is_better", "n", score.alias("trend_score")
    )


def composites(tables: Tables, config: DivergenceConfig = DivergenceConfig()) -> DataFrame:
    """Per entity: observed periods and the two composite scores."""
    counts = F.abs("trend_score") >= F.lit(float(config.min_trend_magnitude))

    def composite(group: str) -> F.Column:
        picked = F.when((F.col("metric_group") == group) & counts, F.col("trend_score"))
        return F.coalesce(F.avg(picked), F.lit(0.0))

    scores = trend_scores(tables).groupBy("entity_id").agg(
        composite("HEADLINE").alias("headline_trend_score"),
        composite("QUALITY").alias("quality_trend_score"),
    )
    spans = observed_metrics(tables).groupBy("entity_id").agg(
        F.count("*").alias("supporting_period_count"),
        F.min("period_start").alias("window_start"),
        F.max("period_start").alias("last_start"),
        F.max_by("period_end", "period_start").alias("window_end"),
    )
    return (
        tables.entities.select("entity_id")
        .join(spans, "entity_id", "left")
        .join(scores, "entity_id", "left")
        .na.fill(0, ["supporting_period_count"])
        .na.fill(0.0, ["headline_trend_score", "quality_trend_score"])
    )


def skipped_entities(tables: Tables, config: DivergenceConfig = DivergenceConfig()) -> DataFrame:
    """Entities with too few periods for a trend."""
    return composites(tables, config).where(
        F.col("supporting_period_count") < config.min_observation_periods
    ).select("entity_id", "supporting_period_count")


def snapshots(tables: Tables) -> DataFrame:
    """The period values behind the trends, one row per entity, KPI and period."""
    return _long(observed_metrics(tables)).where(F.col("value").isNotNull()).select(
        "entity_id", "metric_name", "metric_group", "period_start",
        period_label("period_start").alias("period_label"), "value",
    )


def detect(tables: Tables, config: DivergenceConfig = DivergenceConfig()) -> DataFrame:
    """MRD-001: headline composite up and quality composite down, both past their limits."""
    headline, quality = F.col("headline_trend_score"), F.col("quality_trend_score")
    up, down = float(config.headline_min_improvement), float(config.quality_min_deterioration)
    periods = F.col("supporting_period_count")
    doubled = (headline / F.lit(up) >= 2.0) & (F.abs(quality) / F.lit(down) >= 2.0)
    hits = composites(tables, config).where(
        (periods >= config.min_observation_periods) & (headline >= F.lit(up)) & (quality <= F.lit(-down))
    )
    n_refs = snapshots(tables).groupBy("entity_id").agg(
        F.count("*").alias("n_points"),
        F.countDistinct("metric_name", "period_label").alias("n_values"),
    )
    first, last = period_label("window_start"), period_label("last_start")
    return hits.join(n_refs, "entity_id").select(
        F.concat_ws(":", F.lit("MRD-001"), "entity_id", first, last).alias("finding_key"),
        "entity_id", "window_start", "window_end", "supporting_period_count",
        "headline_trend_score", "quality_trend_score", "n_points", "n_values",
        F.when((periods >= 5) & doubled, "HIGH").otherwise("MODERATE").alias("confidence"),
        F.format_string(
            "Entity %s: headline KPIs trend %+.3f and quality KPIs %+.3f over %d periods (%s to %s). "
            "This describes reported values and states no cause.",
            "entity_id", headline, quality, periods, first, last,
        ).alias("summary"),
        F.format_string(
            "%d reporting periods; headline at %.1f and quality at %.1f times the limit.",
            periods, headline / F.lit(up), F.abs(quality) / F.lit(down),
        ).alias("confidence_note"),
    )
