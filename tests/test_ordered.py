import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsreview.functions.ordered import exact_quantiles, others_median


@pytest.fixture()
def many_blocks(spark):
    """Small data would end up in one block; keep the partitions apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def _groups():
    """One group with most of the rows, many ties, groups of one to five rows, NULLs."""
    rng = random.Random(3)
    rows = [("hot", float(rng.randrange(40)), i) for i in range(500)]
    for size in range(1, 6):
        rows += [(f"g{size}", float(rng.choice([1, 2, 2, 7])), 1000 + 10 * size + i) for i in range(size)]
    return rows + [("hot", None, 9999), ("empty", None, 9998)]


def test_quantiles_equal_numpy(spark, many_blocks):
    rows = _groups()
    df = spark.createDataFrame(rows, "g string, v double, id int")
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.75}, "t").collect()}
    assert set(got) == {"hot", "g1", "g2", "g3", "g4", "g5"}
    for g, r in got.items():
        values = [v for k, v, _ in rows if k == g and v is not None]
        assert r["total"] == len(values)
        assert [r["a"], r["b"], r["c"]] == pytest.approx(list(np.percentile(values, [10, 50, 75])))


def test_others_median_equals_leaving_each_out(spark, many_blocks):
    rows = _groups()
    df = spark.createDataFrame(rows, "g string, v double, id int")
    got = {r["id"]: r for r in others_median(df, ["g"], "v", "m", "t").collect()}
    assert len(got) == len(rows) - 2
    for g, v, i in rows:
        if v is None:
            continue
        others = [x for k, x, j in rows if k == g and x is not None and j != i]
        assert got[i]["others"] == len(others)
        assert got[i]["m"] == (statistics.median(others) if others else None)


def test_rounding_is_that_of_the_exact_binary_value(spark):
    from opsreview.functions.expr import round_half_even

    ratios = [(k, n) for n in range(1, 400) for k in range(n + 1)] + [(1, 160), (3, 160), (1, 32), (123_456, 7)]
    rows = spark.createDataFrame([(float(k / n),) for k, n in ratios], "x double")
    got = [r[0] for r in rows.select(round_half_even(F.col("x"), 4)).collect()]
    assert got == [round(k / n, 4) for k, n in ratios]
