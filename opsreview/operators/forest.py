"""Unusual entity-periods by isolation forest (Liu, Ting and Zhou, 2008).

Sampling, scoring and the cut-off are distributed. Only the growing of a tree is
Python on one task, on the fixed-size subsample the method prescribes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsreview import vocab as V
from opsreview.config import AnomalyConfig
from opsreview.functions.expr import period_label
from opsreview.functions.ordered import exact_quantiles
from opsreview.operators.rollups import PERIOD, period_features
from opsreview.session import write_through
from opsreview.sources.tables import Tables

FEATURES = list(V.MODEL_FEATURES)
_NODE = "tree int, node int, feature int, split double, size int, depth int, psi int"


def model_rows(tables: Tables) -> DataFrame:
    """The feature table, written once, with ``complete``: no model feature is NULL."""
    complete = F.lit(True)
    for name in FEATURES:
        complete = complete & F.col(name).isNotNull()
    return write_through(period_features(tables).withColumn("complete", complete), "period-features")


def population(features: DataFrame) -> DataFrame:
    """One row: observed, complete and incomplete entity-periods."""
    return features.agg(
        F.count("*").alias("observation_count"),
        F.count(F.when(F.col("complete"), 1)).alias("scored_observation_count"),
        F.count(F.when(~F.col("complete"), 1)).alias("dropped_incomplete_count"),
    )


def status(tables_or_features: DataFrame, config: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """One row: OK or INSUFFICIENT_SAMPLE, with the population counts."""
    enough = F.col("scored_observation_count") >= config.min_training_samples
    return population(tables_or_features).select(
        F.when(enough, "OK").otherwise("INSUFFICIENT_SAMPLE").alias("status"), "*"
    )


def _feature_marks(features: DataFrame) -> F.Column:
    """Median and spread of each feature over the complete rows, as one map value."""
    values = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in FEATURES])
    long = features.where("complete").select(F.explode(values).alias("f")).select("f.*")
    marks = exact_quantiles(long, ["feature"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, "feature-quantiles")
    spread = F.when(F.col("q3") > F.col("q1"), F.col("q3") - F.col("q1")).otherwise(F.lit(1.0))
    entries = F.collect_list(F.struct("feature", F.struct("median", spread.alias("spread"))))
    return marks.agg(F.map_from_entries(entries)).scalar()


def _with_notable(rows: DataFrame, marks: F.Column) -> DataFrame:
    def entry(name: str) -> F.Column:
        mark = F.col("_marks")[name]
        gap = F.abs(F.col(name) - mark["median"]) / mark["spread"]
        return F.struct(
            (-F.round(gap, 9)).alias("order"), F.lit(name).alias("name"), F.col(name).alias("value"),
            mark["median"].alias("population_median"),
        )

    ranked = F.slice(F.array_sort(F.array(*[entry(n) for n in FEATURES])), 1, 3)
    return (
        rows.withColumn("_marks", marks)
        .withColumn(
            "notable_features",
            F.transform(ranked, lambda t: F.struct(t["name"].alias("name"), t["value"].alias("value"), t["population_median"].alias("population_median"))),
        )
        .drop("_marks")
    )


def notable_features(features: DataFrame) -> DataFrame:
    """Per complete row the three features farthest from their median, by IQR.

    Distances are compared at nine decimals, so that equal ones rank by name and not
    by the last bit of a division. Rows are only projected; nothing is shuffled.
    """
    return _with_notable(features.where("complete"), _feature_marks(features)).select(
        "entity_id", "period_start", "notable_features"
    )


def _unit_hash(*parts: F.Column) -> F.Column:
    """A reproducible number in [0, 1) from the given values."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def subsamples(rows: DataFrame, n_rows: int, config: AnomalyConfig) -> DataFrame:
    """For each tree, ``min(sample size, rows)`` rows drawn without replacement.

    A row enters a tree's draw with a rate slightly above need, by a hash of (seed,
    tree, key); the lowest hashes of each tree are kept. The draw does not depend on
    partitioning. About trees x sample size rows leave the map side.
    """
    psi = min(config.sample_size, n_rows)
    rate = min(1.0, (psi + 8.0 * math.sqrt(psi) + 16.0) / n_rows)
    seed = F.lit(config.random_state)

    def draw(tree: F.Column) -> F.Column:
        return _unit_hash(seed, tree, F.col("entity_id"), F.date_format("period_start", "yyyyMMddHHmmss"))

    every_tree = F.sequence(F.lit(0), F.lit(config.n_estimators - 1))
    drawn = rows.withColumn(
        "pick",
        F.explode(
            F.filter(
                F.transform(every_tree, lambda t: F.struct(t.alias("tree"), draw(t).alias("u"))),
                lambda p: p["u"] < F.lit(rate),
            )
        ),
    ).select("pick.tree", "pick.u", *PERIOD, *FEATURES)
    place = F.row_number().over(W.partitionBy("tree").orderBy("u", "entity_id", "period_start"))
    return drawn.withColumn("place", place).where(F.col("place") <= psi).select("tree", "u", *FEATURES)


def _grow_tree(seed: int):
    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(sample["tree"].iloc[0])
        values = sample.sort_values(["u", *FEATURES])[FEATURES].to_numpy(dtype=float)
        psi = len(values)
        limit = math.ceil(math.log2(psi)) if psi > 1 else 0
        nodes = []
        waiting = [(0, np.arange(psi), 0)]
        while waiting:
            node, members, depth = waiting.pop()
            low, high = values[members].min(axis=0), values[members].max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or len(members) <= 1 or len(usable) == 0:
                nodes.append((tree, node, -1, 0.0, len(members), depth, psi))
                continue
            rng = np.random.default_rng([seed, tree, node])
            feature = int(rng.choice(usable))
            split = float(rng.uniform(low[feature], high[feature]))
            left = values[members, feature] <= split
            nodes.append((tree, node, feature, split, len(members), depth, psi))
            waiting.append((2 * node + 1, members[left], depth + 1))
            waiting.append((2 * node + 2, members[~left], depth + 1))
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "split", "size", "depth", "psi"])

    return grow


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Average path length of an unsuccessful search among ``n`` values."""
    n = np.asarray(n, dtype=float)
    large = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + 0.5772156649) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, large, np.where(n == 2, 1.0, 0.0))


def _scorer(nodes: pd.DataFrame):
    """Score rows against every tree; the node table is bounded by trees x sample size."""
    trees = []
    for _, t in nodes.groupby("tree"):
        size = int(t["node"].max()) + 1
        feature, split, length = np.full(size, -1), np.zeros(size), np.zeros(size)
        at = t["node"].to_numpy()
        feature[at], split[at] = t["feature"], t["split"]
        length[at] = t["depth"] + _mean_path(t["size"])
        trees.append((feature, split, length, float(_mean_path(t["psi"].iloc[0]))))

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        values = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        total, norm = np.zeros(len(values)), 0.0
        for feature, split, length, expected in trees:
            node = np.zeros(len(values), dtype=np.int64)
            while True:
                inner = np.flatnonzero(feature[node] >= 0)
                if len(inner) == 0:
                    break
                here = node[inner]
                goes_left = values[inner, feature[here]] <= split[here]
                node[inner] = 2 * here + np.where(goes_left, 1, 2)
            total += length[node]
            norm += expected
        return pd.Series(-np.power(2.0, -total / max(norm, 1e-12)))

    return score


def scores(features: DataFrame, config: AnomalyConfig = AnomalyConfig(), n_rows: int | None = None) -> DataFrame:
    """``raw_anomaly_score`` (higher = more normal) of each of the ``n_rows`` complete rows."""
    rows = features.where("complete")
    n_rows = rows.count() if n_rows is None else n_rows
    sample = subsamples(rows, n_rows, config)
    nodes = sample.groupBy("tree").applyInPandas(_grow_tree(config.random_state), _NODE).toPandas()
    score = _scorer(nodes)
    return write_through(
        rows.select(*PERIOD, *FEATURES, score(*FEATURES).alias("raw_anomaly_score")).withColumn("model", F.lit("forest")),
        "forest-scores",
    )


def detect(features: DataFrame, config: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """AN-001: the lowest-scoring share of complete entity-periods.

    With fewer complete rows than the minimum nothing is scored and no row comes
    out; :func:`status` says so.
    """
    counts = population(features).first()
    if counts["scored_observation_count"] < config.min_training_samples:
        scored = features.where(F.lit(False)).select(
            *PERIOD, *FEATURES, F.lit(0.0).alias("raw_anomaly_score"), F.lit("forest").alias("model")
        )
    else:
        scored = scores(features, config, counts["scored_observation_count"])
    cut = exact_quantiles(scored, ["model"], "raw_anomaly_score", {"cut": config.contamination}, "forest-cut")
    span = scored.groupBy("model").agg(
        F.max("raw_anomaly_score").alias("highest"), F.min("raw_anomaly_score").alias("lowest")
    )
    width = F.col("highest") - F.col("lowest")
    signal = F.coalesce(F.try_divide(F.col("highest") - F.col("raw_anomaly_score"), width), F.lit(0.0))
    label = period_label("period_start")
    flagged = (
        scored.join(cut, "model")
        .join(span, "model")
        .where(F.col("raw_anomaly_score") < F.col("cut"))
        .withColumn("normalized_anomaly_score", signal)
    )
    return (
        _with_notable(flagged, _feature_marks(features))
        .select(
            F.concat_ws(":", F.lit("AN-001"), "entity_id", label).alias("finding_key"),
            *PERIOD,
            F.lit("ANOMALOUS").alias("decision"),
            "raw_anomaly_score",
            "normalized_anomaly_score",
            F.create_map(*[x for n in FEATURES for x in (F.lit(n), F.col(n))]).alias("feature_snapshot"),
            "notable_features",
            F.lit(int(counts["scored_observation_count"])).cast("bigint").alias("scored_observation_count"),
            F.lit(int(counts["dropped_incomplete_count"])).cast("bigint").alias("dropped_incomplete_count"),
            F.format_string(
                f"Entity %s in %s is unusual among {int(counts['scored_observation_count'])} entity-periods "
                "(signal %.2f). This is a pointer for review, not a judgement.",
                "entity_id", label, "normalized_anomaly_score",
            ).alias("summary"),
        )
    )
