"""Bloom filters over stored keys, as tables.

A filter is a table of blocks of eight 64-bit words. A key belongs to one block and sets one bit in each of
its words, so a filter is built by one grouped ``bit_or`` and probed by a join on the block number: both are
plain expressions, a filter of any size is spread over its rows, and filters of several parts of a
table, of any sizes, can be laid together without being merged. A key that a filter does not hold is certainly not stored; a key that
it holds must be looked up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsreview.session import write_through

WORDS = tuple(f"w{i}" for i in range(8))


@dataclass(frozen=True)
class KeyFilter:
    """Rows ``blocks, block, w0, ..., w7`` of one or more filters; ``sizes``: the numbers of blocks that occur."""

    rows: DataFrame
    sizes: tuple[int, ...]


def blocks_for(keys: int, bits_per_key: float = 12.0) -> int:
    """Blocks for so many keys, a power of two, so that filters of few sizes occur: at 12 bits a key at most
    one absent key in about 200 is taken for a hit."""
    return 1 << max(0, math.ceil(math.log2(max(1.0, keys * bits_per_key / 512))))


def _block(value: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(value, F.lit("block")), blocks)


def _masks(value: Column) -> list[Column]:
    first, second = F.xxhash64(value), F.xxhash64(value, F.lit("words"))
    halves = [first, second]
    # Ten bits of hash apart, six bits used.
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(halves[i % 2], 10 * (i // 2)).bitwiseAND(63).cast("int")) for i in range(8)]


def build(rows: DataFrame, column: str, blocks: int) -> DataFrame:
    """The filter rows of a key column; nulls are left out."""
    key = F.col(column).cast("string")
    size = F.lit(blocks).cast("long")
    masks = rows.where(F.col(column).isNotNull()).select(size.alias("blocks"), _block(key, size).alias("block"), *[m.alias(w) for m, w in zip(_masks(key), WORDS, strict=True)])
    return masks.groupBy("blocks", "block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def hits(values: DataFrame, column: str, keys: KeyFilter) -> DataFrame:
    """Distinct values of ``column`` that the filter holds, written through, so their size is known to what looks them up."""
    key = F.col(column).cast("string")
    asked = values.where(F.col(column).isNotNull()).select(column).distinct()
    asked = asked.withColumn("blocks", F.explode(F.lit(list(keys.sizes)).cast("array<bigint>")))
    asked = asked.select(column, "blocks", _block(key, F.col("blocks")).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks(key))])
    held = F.lit(True)
    for i, w in enumerate(WORDS):
        held = held & (F.col(w).bitwiseAND(F.col(f"m{i}")) != 0)
    return write_through(asked.join(keys.rows, ["blocks", "block"]).where(held).select(column).distinct(), "key-hits")


def stored_among(values: DataFrame, column: str, stored: DataFrame, stored_column: str, keys: KeyFilter) -> DataFrame:
    """Distinct values of ``column`` that are stored. Only hits of the filter are looked up: where they are few, they go to
    the stored rows and these are not shuffled."""
    found = hits(values, column, keys)
    return stored.select(F.col(stored_column).alias(column)).join(found, column, "left_semi").distinct()
