import statistics
import random

import pytest

from opsreview.config import DivergenceConfig, PeerConfig
from opsreview.operators import peers, trend
from tests.world import keys, month, monthly_kpis, world


def _peer_world(spark, values, metric="closure_rate", **entity):
    entities = [dict(entity_id=f"ENT-{i:02d}", **entity) for i in range(len(values))]
    kpis = [r for i, v in enumerate(values) for r in monthly_kpis(1, f"ENT-{i:02d}", **{metric: [v]})]
    return world(spark, entities=entities, performance_metrics=kpis)


def test_identical_peers_use_the_absolute_floor(spark):
    found = peers.detect(_peer_world(spark, [0.5, 0.5, 0.5, 0.65])).collect()
    assert [r["finding_key"] for r in found] == ["PB-001:ENT-03:2024-01:closure_rate"]
    assert (found[0]["deviation_basis"], found[0]["direction"], found[0]["peer_population_count"]) == ("ABSOLUTE_ZERO_MAD", "ABOVE", 3)
    assert peers.detect(_peer_world(spark, [0.5, 0.5, 0.5, 0.64])).count() == 0
    assert peers.detect(_peer_world(spark, [0.5, 0.5, 0.5, 0.64]), PeerConfig(abs_threshold_overrides={"closure_rate": 0.1})).count() == 1
    assert peers.detect(_peer_world(spark, [5.0, 5.0, 5.0, 7.0], "mttr_hours")).count() == 1
    assert peers.detect(_peer_world(spark, [5.0, 5.0, 5.0, 6.9], "mttr_hours")).count() == 0


def test_distance_of_exactly_the_threshold_counts(spark):
    # peers 0, 2, 4: median 2, deviations 2, 0, 2 -> MAD 2; scale 1 makes the distance exact
    config = PeerConfig(mad_scale_factor=1.0, mad_threshold=3.5)
    at = peers.detect(_peer_world(spark, [0.0, 2.0, 4.0, 9.0], "mttr_hours"), config).where("entity_id = 'ENT-03'")
    below = peers.detect(_peer_world(spark, [0.0, 2.0, 4.0, 8.9], "mttr_hours"), config).where("entity_id = 'ENT-03'")
    assert at.first()["deviation_measure"] == 3.5 and below.count() == 0


def test_too_few_peers_give_a_status(spark):
    t = _peer_world(spark, [0.1, 0.9])
    assert peers.detect(t).count() == 0
    assert peers.peer_status(t).count() == 2
    assert peers.peer_status(t).first()["peer_population_count"] == 1
    assert peers.peer_status(_peer_world(spark, [0.1, 0.5, 0.9])).count() == 0


def test_groups_and_periods_do_not_mix(spark):
    entities = [dict(entity_id=f"ENT-{i:02d}", scale="SMALL" if i < 3 else "LARGE") for i in range(6)]
    kpis = [r for i in range(6) for r in monthly_kpis(1, f"ENT-{i:02d}", closure_rate=[0.2 if i < 3 else 0.9])]
    assert peers.detect(world(spark, entities=entities, performance_metrics=kpis)).count() == 0


def test_against_brute_force(spark):
    rng = random.Random(5)
    values = [round(rng.choice([0.1, 0.2, 0.5, rng.random()]), 4) for _ in range(31)]
    got = {r["entity_id"]: r for r in peers.detect(_peer_world(spark, values)).where("metric_name = 'closure_rate'").collect()}
    for i, v in enumerate(values):
        others = values[:i] + values[i + 1:]
        middle = statistics.median(others)
        mad = 1.4826 * statistics.median([abs(x - middle) for x in others])
        flagged = abs(v - middle) / mad >= 3.5 if mad else abs(v - middle) >= 0.15
        assert (f"ENT-{i:02d}" in got) == flagged
        if flagged:
            assert got[f"ENT-{i:02d}"]["peer_baseline"] == pytest.approx(middle)


def test_newest_row_of_a_period_wins(spark):
    t = _peer_world(spark, [0.5, 0.5, 0.5])
    extra = world(spark, performance_metrics=[dict(metric_id="PMET-9", entity_id="ENT-02", closure_rate=0.9)])
    both = t.performance_metrics.unionByName(extra.performance_metrics)
    found = peers.detect(t.replace(performance_metrics=both))
    assert keys(found) == ["PB-001:ENT-02:2024-01:closure_rate"]


UP, DOWN = (lambda i: 0.1 + 0.1 * i), (lambda i: 0.9 - 0.1 * i)
DIVERGING = dict(
    closure_rate=UP, sla_compliance=UP, mttr_hours=lambda i: 10.0 - i, investigation_completeness=DOWN,
    evidence_completeness=DOWN, remediation_rate=DOWN, recurrence_rate=UP,
)


def test_linear_profile_scores_one(spark):
    found = trend.detect(world(spark, performance_metrics=monthly_kpis(6, **DIVERGING))).collect()
    assert [r["finding_key"] for r in found] == ["MRD-001:ENT-01:2024-01:2024-06"]
    assert found[0]["headline_trend_score"] == pytest.approx(1.0)
    assert found[0]["quality_trend_score"] == pytest.approx(-1.0)
    assert found[0]["confidence"] == "HIGH" and found[0]["n_values"] == 42


def test_period_rules(spark):
    assert trend.detect(world(spark, performance_metrics=monthly_kpis(4, **DIVERGING))).first()["confidence"] == "MODERATE"
    short = world(spark, performance_metrics=monthly_kpis(3, **DIVERGING))
    assert trend.detect(short).count() == 0 and trend.skipped_entities(short).count() == 1
    # periods from the data end on are not looked at
    late = world(spark, performance_metrics=monthly_kpis(9, **DIVERGING))
    assert trend.detect(late).first()["supporting_period_count"] == 6


def test_flat_constant_and_two_point_series(spark):
    def scores(n, **series):
        rows = trend.trend_scores(world(spark, performance_metrics=monthly_kpis(n, **series))).collect()
        return {r["metric_name"]: r["trend_score"] for r in rows}

    assert scores(5)["closure_rate"] == 0.0
    two = scores(2, closure_rate=[0.5, 0.75], mttr_hours=[4.0, 2.0])
    assert two["closure_rate"] == pytest.approx(1 / 3) and two["mttr_hours"] == pytest.approx(0.5)
    assert scores(1)["closure_rate"] is None


def test_improvement_alone_is_no_divergence(spark):
    series = {**DIVERGING, "investigation_completeness": UP, "evidence_completeness": UP, "remediation_rate": UP, "recurrence_rate": DOWN}
    assert trend.detect(world(spark, performance_metrics=monthly_kpis(6, **series))).count() == 0


def test_bad_settings():
    for bad in (dict(peer_dimension="name"), dict(peer_min_count=0), dict(mad_threshold=0), dict(mad_scale_factor=0), dict(abs_threshold_overrides={"closure_rate": -1})):
        with pytest.raises(ValueError):
            PeerConfig(**bad)
    for bad in (dict(min_observation_periods=1), dict(headline_min_improvement=0), dict(quality_min_deterioration=0), dict(min_trend_magnitude=-0.1)):
        with pytest.raises(ValueError):
            DivergenceConfig(**bad)
    assert month(12).year == 2025
