"""The plans Spark makes: join strategies, pushdown, pruning, Python use."""

import re

import pytest

from opsreview.operators import execution_gap, negative_space, sequences
from opsreview.config import ExecutionGapConfig, NegativeSpaceConfig
from opsreview.plans.catalog import QUERIES
from opsreview.sources.tables import Tables
from tests.world import world

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.mark.parametrize(
    "name",
    [
        "kpi_rollup", "period_features", "eg001_unescalated", "eg002_uninvestigated", "eg003_unremediated", "eg003_members",
        "ns001_silent_assets", "ns002_vanished_telemetry", "pb001_peer_deviation", "trend_scores", "mrd001_divergence",
        "running_baseline", "if_dev002_deviation", "if_rep001_members", "ingest_alert_issues", "queue_merge", "evidence_unsupported",
    ],
)
def test_no_pairwise_joins_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text)
    assert not re.search(r"EvalPython|InPandas|InArrow", text)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    for name, df in world(spark).items().items():
        df.write.parquet(f"{folder}/{name}")
    return Tables.read(spark, folder)


def scans(spark, df) -> str:
    """The formatted plan, with scan details in full."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def _scan(text: str, table: str) -> str:
    return next(part for part in text.split("\n\n") if "Scan parquet" in part and f"/{table}]" in part)


def test_filters_and_columns_reach_the_scan(spark, stored):
    text = scans(spark, execution_gap.unescalated_alerts(stored.scoped(["ENT-01"]), ExecutionGapConfig()))
    scan = _scan(text, "alerts")
    for pushed in ("EqualTo(entity_id,ENT-01)", "EqualTo(severity,CRITICAL)", "EqualTo(status,CLOSED)"):
        assert pushed in scan
    assert "detection_source" not in scan.split("ReadSchema")[1] and "category" not in scan.split("ReadSchema")[1]
    assert "created_at" not in _scan(text, "escalations").split("ReadSchema")[1]
    text = scans(spark, negative_space.silent_assets(stored, NegativeSpaceConfig()))
    assert "EqualTo(criticality,CRITICAL)" in _scan(text, "assets") and "event_count" not in _scan(text, "telemetry").split("ReadSchema")[1]


def test_a_filter_on_the_category_drops_other_detectors(spark, stored):
    from opsreview.operators import findings

    parts = {
        "execution_gap": execution_gap.detect(stored),
        "negative_space": negative_space.detect(stored),
    }
    text = scans(spark, findings.select_findings(findings.unified(parts), category="MONITORING_GAP"))
    assert "/telemetry]" in text and "/escalations]" not in text


def test_the_order_of_input_does_not_matter(spark):
    tables = QUERIES["action_sequences"](spark, FOLDER)
    once = {tuple(r) for r in tables.repartition(1).collect()}
    assert once == {tuple(r) for r in tables.repartition(17).collect()}


def test_a_hot_entity_is_spread(spark):
    """One entity with nearly all rows must not end up in one task."""
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 4000
        df = spark.range(n).select(
            F.format_string("INV-%06d", "id").alias("investigation_id"),
            F.when(F.col("id") % 50 == 0, "ENT-02").otherwise("ENT-01").alias("entity_id"),
            F.to_timestamp(F.lit("2024-01-01")).alias("period_start"),
            F.to_timestamp(F.lit("2024-02-01")).alias("period_end"),
            F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 2).alias("letters"),
            F.lit(2).alias("action_count"),
        )
        records = sequences.in_blocks(df, ["entity_id"], ["period_start", "investigation_id"], "hot")
        sizes = [r["count"] for r in records.groupBy("block").count().collect()]
        assert len(sizes) == 4 and max(sizes) < n / 2
        assert sequences.running_baseline(records).count() == n - 6
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
