import numpy as np
import pytest
from pyspark.sql import functions as F

from opsreview.config import AnomalyConfig
from opsreview.operators import forest
from opsreview.operators.rollups import period_features
from tests.world import DAY, START, month, monthly_kpis, world


def _features(spark, n=60, odd=None):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        values = rng.normal(10, 1, len(forest.FEATURES))
        if i == odd:
            values += 40
        rows.append((f"ENT-{i:03d}", month(0), month(1), *[float(v) for v in values], 1.0, None, True))
    names = ", ".join(f"{c} double" for c in (*forest.FEATURES, "alert_count", "rem_rate"))
    return spark.createDataFrame(rows, f"entity_id string, period_start timestamp, period_end timestamp, {names}, complete boolean")


def test_extreme_row_share_and_repartition(spark):
    config = AnomalyConfig(n_estimators=50)
    features = _features(spark, odd=7)
    found = forest.detect(features.repartition(1), config).collect()
    assert len(found) == 6  # the lowest 10 % of 60
    worst = min(found, key=lambda r: r["raw_anomaly_score"])
    assert worst["entity_id"] == "ENT-007" and worst["normalized_anomaly_score"] == 1.0
    assert len(worst["notable_features"]) == 3 and len(worst["feature_snapshot"]) == 9
    again = forest.detect(features.repartition(5), config).collect()
    assert {r["finding_key"]: r["raw_anomaly_score"] for r in again} == {r["finding_key"]: r["raw_anomaly_score"] for r in found}
    other = forest.detect(features, AnomalyConfig(n_estimators=50, random_state=1)).collect()
    assert {r["raw_anomaly_score"] for r in other} != {r["raw_anomaly_score"] for r in found}


def test_every_tree_gets_its_sample(spark):
    config = AnomalyConfig(n_estimators=20, max_samples=16)
    sizes = forest.subsamples(_features(spark), 60, config).groupBy("tree").count().collect()
    assert len(sizes) == 20 and {r["count"] for r in sizes} == {16}


def test_identical_rows_are_not_flagged(spark):
    features = _features(spark).select("entity_id", "period_start", "period_end", *[F.lit(1.0).alias(c) for c in forest.FEATURES], "complete")
    assert forest.detect(features, AnomalyConfig(n_estimators=5)).count() == 0


def test_small_sample_gives_a_status(spark):
    features = _features(spark, n=19)
    assert forest.status(features).first()["status"] == "INSUFFICIENT_SAMPLE"
    assert forest.detect(features).count() == 0
    assert forest.status(_features(spark, n=20)).first()["status"] == "OK"


def test_mean_path_constants():
    assert list(forest._mean_path(np.array([0, 1, 2]))) == [0.0, 0.0, 1.0]
    assert float(forest._mean_path(256)) == pytest.approx(10.2448, abs=1e-3)


def test_features_are_null_where_undefined(spark):
    t = world(
        spark,
        alerts=[dict(alert_id="ALR-1", severity="HIGH"), dict(alert_id="ALR-2", severity="LOW", is_true_positive=None)],
        investigations=[dict(started_at=START + DAY)],
        investigation_actions=[dict(action_id=f"ACT-{i}", sequence_number=i) for i in (1, 2, 3)],
        escalations=[dict(investigation_id="INV-1"), dict(escalation_id="ESC-2", investigation_id="INV-1")],
        remediations=[dict(investigation_id="INV-1")],
        performance_metrics=monthly_kpis(2),
    )
    first, second = period_features(t).orderBy("period_start").collect()
    assert first["alerts_per_asset"] == 0.2 and first["crit_high_rate"] == 0.5 and first["tp_rate"] == 1.0
    assert first["inv_coverage"] == 0.5 and first["esc_rate"] == 1.0 and first["mean_inv_dur_h"] == 1.0
    assert first["mean_actions"] == 3.0 and first["mean_evidence"] == 4.0 and first["rem_rate"] == 1.0
    assert second["alerts_per_asset"] == 0.0 and second["alert_count"] == 0.0
    assert all(second[c] is None for c in ("crit_high_rate", "tp_rate", "closure_rate", "inv_coverage", "esc_rate", "mean_actions", "rem_rate"))
    counts = forest.population(forest.model_rows(t)).first()
    assert (counts["observation_count"], counts["dropped_incomplete_count"]) == (2, 1)


@pytest.mark.parametrize("bad", [dict(n_estimators=0), dict(contamination=0), dict(contamination=0.6), dict(min_training_samples=0), dict(max_samples=0)])
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        AnomalyConfig(**bad)
