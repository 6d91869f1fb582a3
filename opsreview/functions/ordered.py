"""Order-dependent statistics that never sort a whole group in one task.

A window over ``partitionBy(key)`` puts every row of a key into one task, and one
key may hold a third of the data. Here the rows are range-partitioned by key and
order instead, so a large key is spread over consecutive *blocks*. A running value
is then the value within the block combined with one summary row per earlier
block. A key contributes at most one summary row per block, so the second step
is small whatever the key holds. Results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsreview.session import write_through

BLOCK = "block"


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Add ``block``: consecutive numbers along (keys, order), written once.

    Block limits come from sampling, so the table is written before use: every
    later read, also after a lost executor, sees the same blocks. The order must
    be unique within a key for block sizes to be even.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn(BLOCK, F.spark_partition_id())
    return write_through(ranged, label)


def within_block(keys: Sequence[str], order: Sequence[str | Column]) -> W:
    return W.partitionBy(BLOCK, *keys).orderBy(*order)


def earlier_blocks(keys: Sequence[str]) -> W:
    return W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)


def _running_counts(blocks: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """For rows ``(keys, value, n)``: ``upto``, the running sum of ``n`` by value."""
    inside = within_block(keys, [value]).rowsBetween(W.unboundedPreceding, 0)
    sums = blocks.groupBy(*keys, BLOCK).agg(F.sum("n").alias("block_n"))
    before = sums.select(
        *keys,
        BLOCK,
        F.coalesce(F.sum("block_n").over(earlier_blocks(keys)), F.lit(0)).alias("before"),
    )
    return (
        blocks.withColumn("inside", F.sum("n").over(inside))
        .join(before, [*keys, BLOCK])
        .withColumn("upto", F.col("inside") + F.col("before"))
        .drop("inside", "before", BLOCK)
    )


def _values_at(
    df: DataFrame, keys: Sequence[str], value: str, picks: dict[str, Column], label: str
) -> DataFrame:
    """Per key: ``total`` and the sorted values at the 0-based positions ``picks``.

    A position is an expression over ``total``. Positions outside the group give
    NULL. Equal values are counted first, so the shuffle carries distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    blocks = in_blocks(counts, keys, [value], label)
    totals = blocks.groupBy(*keys).agg(F.sum("n").alias("total"))
    ranked = _running_counts(blocks, keys, value).join(totals, list(keys))

    def first_past(position: Column) -> Column:
        hit = (position >= 0) & (F.col("upto") > position)
        return F.min(F.when(hit, F.col(value)))

    return ranked.groupBy(*keys).agg(
        F.first("total").alias("total"),
        *[first_past(position).alias(name) for name, position in picks.items()],
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], label: str
) -> DataFrame:
    """Exact quantiles with linear interpolation: ``keys, total, *probs``."""
    last = F.col("total") - 1
    picks: dict[str, Column] = {}
    for name, p in probs.items():
        picks[f"{name}_low"] = F.floor(last * F.lit(float(p)))
        picks[f"{name}_high"] = F.ceil(last * F.lit(float(p)))
    at = _values_at(df, keys, value, picks, label)

    def between(name: str, p: float) -> Column:
        position = last * F.lit(float(p))
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        return low + (position - F.floor(position)) * (high - low)

    return at.select(*keys, "total", *[between(n, p).alias(n) for n, p in probs.items()])


def others_median(df: DataFrame, keys: Sequence[str], value: str, out: str, label: str) -> DataFrame:
    """Add to each row ``out``: the median of the *other* rows of its group, and
    ``others``: how many they are. Rows with NULL values are left out.

    Taking one value out of a sorted group shifts its middle by at most one place,
    so the three values around the middle decide the answer for every row. No row
    is ever paired with the rows of its group.
    """
    middle = F.floor((F.col("total") - 1) / 2).cast("long")
    around = _values_at(
        df,
        keys,
        value,
        {"left": middle - 1, "mid": middle, "right": middle + 1},
        label,
    )
    v = F.col(value)
    upper = F.when(v <= F.col("mid"), F.col("right")).otherwise(F.col("mid"))
    lower = F.when(v <= F.col("left"), F.col("mid")).otherwise(F.col("left"))
    return (
        df.where(v.isNotNull())
        .join(around, list(keys))
        .withColumn(
            out, F.when(F.col("total") % 2 == 0, upper).otherwise((lower + upper) / F.lit(2.0))
        )
        .withColumn("others", F.col("total") - 1)
        .drop("total", "left", "mid", "right")
    )
