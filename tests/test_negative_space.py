import pytest

from opsreview.config import NegativeSpaceConfig
from opsreview.operators import negative_space as ns
from tests.world import DAY, END, HOUR, START, keys, world

CONFIG = NegativeSpaceConfig()


def test_silent_assets(spark):
    assets = [
        dict(asset_id="AST-1"),
        dict(asset_id="AST-2", criticality="HIGH"),
        dict(asset_id="AST-3", monitoring_expected=False),
        dict(asset_id="AST-4"),  # one record of another category is enough
        dict(asset_id="AST-5", entity_id="ENT-02"),  # observed too briefly
    ]
    entities = [{}, dict(entity_id="ENT-02", data_period_end=START + 23 * HOUR)]
    t = world(spark, entities=entities, assets=assets, telemetry=[dict(asset_id="AST-4", category="EMAIL")])
    assert keys(ns.silent_assets(t, CONFIG)) == ["NS-001:AST-1"]
    loose = NegativeSpaceConfig(monitoring_require_expected_flag=False, monitoring_min_criticality="HIGH")
    assert keys(ns.silent_assets(t, loose)) == ["NS-001:AST-1", "NS-001:AST-2", "NS-001:AST-3"]


def test_window_of_exactly_the_minimum_counts(spark):
    t = world(spark, entities=[dict(data_period_end=START + 24 * HOUR)], assets=[{}])
    assert ns.silent_assets(t, CONFIG).count() == 1


@pytest.mark.parametrize("hours, found", [(719.99, False), (720.0, True), (721.5, True)])
def test_silence_threshold(spark, hours, found):
    last = END - hours * HOUR
    telemetry = [
        dict(telemetry_id="TLM-1"),
        dict(telemetry_id="TLM-2", period_start=last - DAY, period_end=last),
    ]
    rows = ns.vanished_telemetry(world(spark, assets=[{}], telemetry=telemetry), CONFIG).collect()
    assert bool(rows) is found
    if found:
        assert rows[0]["silence_hours"] == pytest.approx(hours)
        assert rows[0]["baseline_observation_count"] == 2


def test_one_record_is_no_baseline_and_full_coverage_is_no_gap(spark):
    assets = [dict(asset_id="AST-1"), dict(asset_id="AST-2")]
    telemetry = [
        dict(telemetry_id="TLM-1", asset_id="AST-1"),
        dict(telemetry_id="TLM-2", asset_id="AST-2"),
        dict(telemetry_id="TLM-3", asset_id="AST-2", period_end=END),
    ]
    assert ns.vanished_telemetry(world(spark, assets=assets, telemetry=telemetry), CONFIG).count() == 0


def test_members(spark):
    telemetry = [dict(telemetry_id=f"TLM-{i}") for i in (1, 2, 3)]
    t = world(spark, assets=[{}], telemetry=telemetry)
    found = ns.detect(t)
    assert keys(found) == ["NS-002:AST-1"]
    assert ns.telemetry_members(t, found).count() == 3


@pytest.mark.parametrize(
    "bad",
    [dict(monitoring_min_observation_hours=-1), dict(telemetry_gap_threshold_hours=-1), dict(disappearance_min_baseline_periods=0)],
)
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        NegativeSpaceConfig(**bad)
