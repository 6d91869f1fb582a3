"""Soundness of stored tables: one row per check with the number of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsreview.functions.ordered import BLOCK, earlier_blocks, in_blocks, within_block
from opsreview.schemas import DATASETS
from opsreview.sources.tables import Tables


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def _counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Rows that meet each condition, all counted in one pass over the table."""
    names = list(conditions)
    counted = df.agg(*[F.count_if(condition).alias(f"n{i}") for i, condition in enumerate(conditions.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"n{i}").alias("violations")) for i, name in enumerate(names)])
    return counted.select(F.inline(rows))


def _repeated(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """Rows beyond the first of each value."""
    groups = df.groupBy(*columns).agg((F.count("*") - 1).alias("extra"))
    return groups.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def key_checks(tables: Tables) -> list[DataFrame]:
    checks = []
    for name, df in tables.items().items():
        dataset = DATASETS[name]
        checks.append(_repeated(df, f"{name}: key unique", dataset.key))
        for column in dataset.unique:
            checks.append(_repeated(df.where(F.col(column).isNotNull()), f"{name}: {column} unique", column))
        for f in dataset.fields:
            if f.references:
                target = getattr(tables, f.references).select(F.col(DATASETS[f.references].key).alias(f.name))
                used = df.where(F.col(f.name).isNotNull()).groupBy(f.name).agg(F.count("*").alias("n"))
                missing = used.join(target, f.name, "left_anti")
                checks.append(
                    missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
                        F.lit(f"{name}: {f.name} exists").alias("check"), "violations"
                    )
                )
    metrics = tables.performance_metrics
    checks.append(_repeated(metrics, "performance_metrics: one row per period", "entity_id", "period_start"))
    return checks


def order_checks(tables: Tables) -> list[DataFrame]:
    return [
        _counts(df, {f"{name}: {later} not before {earlier}": F.col(later) < F.col(earlier) for earlier, later in DATASETS[name].ordered})
        for name, df in tables.items().items()
        if DATASETS[name].ordered
    ]


def action_checks(tables: Tables) -> list[DataFrame]:
    """Sequence numbers run 1..n, times do not go back, actions lie within their investigation.

    Numbers are judged by mergeable aggregates. For times, rows of equal number are
    reduced to their span, and each span is compared with the one before it; blocks
    keep a very long investigation out of a single task.
    """
    actions = tables.investigation_actions
    own, order = ["investigation_id"], ["sequence_number"]
    spans = in_blocks(
        actions.groupBy(*own, *order).agg(
            F.count("*").alias("n"), F.min("occurred_at").alias("from"), F.max("occurred_at").alias("to")
        ),
        own, order, "action-spans",
    )
    runs = spans.groupBy(*own).agg(
        F.sum("n").alias("n"), F.count("*").alias("numbers"),
        F.min("sequence_number").alias("low"), F.max("sequence_number").alias("high"),
    )
    gapless = (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("numbers") == F.col("n"))
    tails = spans.groupBy(*own, BLOCK).agg(F.max_by("to", "sequence_number").alias("tail"))
    carried = tails.select(*own, BLOCK, F.last("tail").over(earlier_blocks(own)).alias("carried"))
    backward = (
        spans.withColumn("before", F.lag("to").over(within_block(own, order)))
        .join(carried, [*own, BLOCK])
        .where(F.col("from") < F.coalesce("before", "carried"))
    )
    window = tables.investigations.select("investigation_id", "started_at", "ended_at")
    outside: Column = (F.col("occurred_at") < F.col("started_at")) | (F.col("occurred_at") > F.col("ended_at"))
    return [
        _count(runs.where(~gapless), "investigation_actions: numbers run 1..n"),
        _count(backward, "investigation_actions: time does not go back"),
        _count(actions.join(window, "investigation_id").where(outside), "investigation_actions: within the investigation"),
    ]


def monitoring_checks(tables: Tables) -> list[DataFrame]:
    assets = tables.assets
    severe = F.col("criticality").isin("HIGH", "CRITICAL")
    bare = severe & (~F.col("monitoring_expected") | F.col("expected_telemetry").isNull())
    unmonitored = tables.telemetry.select("asset_id").join(
        assets.where("monitoring_expected").select("asset_id"), "asset_id", "left_anti"
    )
    return [
        _count(assets.where(bare), "assets: severe ones are monitored"),
        _count(unmonitored, "telemetry: only of monitored assets"),
    ]


def audit(tables: Tables) -> DataFrame:
    """All checks as ``(check, violations)``."""
    checks = key_checks(tables) + order_checks(tables) + action_checks(tables) + monitoring_checks(tables)
    result = checks[0]
    for check in checks[1:]:
        result = result.unionByName(check)
    return result
