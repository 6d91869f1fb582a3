"""The telemetry stream against its batch twin, late records, and a restart."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from opsreview.schemas import DATASETS
from opsreview.streaming.telemetry import RollupSettings, rolled_up, start

DAY = datetime(2024, 1, 1)


def records(spark, rows):
    """Rows of (asset, hours since the first day, events)."""
    data = [(f"TLM-{k}", "ENT-01", f"AST-{a}", DAY + timedelta(hours=h), DAY + timedelta(hours=h + 1), "DNS", n, 1.0, "HEALTHY", True) for k, (a, h, n) in enumerate(rows)]
    return spark.createDataFrame(data, DATASETS["telemetry"].struct)


def put(spark, rows, folder):
    records(spark, rows).coalesce(1).write.mode("append").parquet(folder)


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def folders(tmp_path):
    return tuple(str(tmp_path / n) for n in ("in", "out", "check"))


def run(spark, folders, settings):
    query = start(spark, *folders, settings)
    query.awaitTermination(120)
    assert query.exception() is None


def written(spark, folders):
    return spark.read.parquet(folders[1])


def test_closed_windows_equal_the_batch_twin(spark, folders):
    settings = RollupSettings(late="1 day")
    rows = [(a, h, (a * h) % 3) for a in range(4) for h in range(0, 24 * 8, 5)]
    put(spark, rows, folders[0])
    run(spark, folders, settings)
    last = max(h for _, h, _ in rows)
    closed = rolled_up(records(spark, rows), settings).where(F.col("window_end") <= F.lit(DAY + timedelta(hours=last) - timedelta(days=1)))
    assert result(written(spark, folders)) == result(closed) and closed.count() == 4 * 6


def test_a_restart_goes_on_and_late_records_are_left_out(spark, folders):
    settings = RollupSettings(late="1 day")
    put(spark, [(1, 1, 5), (1, 30, 6)], folders[0])
    run(spark, folders, settings)
    put(spark, [(1, 2, 7), (1, 80, 1)], folders[0])  # the first day is still open: hour 30 closes none
    run(spark, folders, settings)
    put(spark, [(1, 3, 100), (1, 200, 1)], folders[0])  # hour 80 has closed the first day
    run(spark, folders, settings)
    run(spark, folders, settings)  # nothing new
    got = {(r["window_start"] - DAY).days: (r["records"], r["event_count"]) for r in written(spark, folders).collect()}
    assert got == {0: (2, 12), 1: (1, 6), 3: (1, 1)} and written(spark, folders).count() == 3


def test_rows_without_time_and_empty_tables(spark):
    rows = records(spark, [(1, 1, 5)]).unionByName(records(spark, [(1, 2, 9)]).withColumn("period_start", F.lit(None).cast("timestamp")))
    assert [(r["records"], r["event_count"]) for r in rolled_up(rows).collect()] == [(1, 5)]
    assert rolled_up(rows.limit(0)).collect() == []
