"""Pages of a sorted table by number, at any depth, together with the total.

The rows are written once in blocks along their order, and each block is counted: one small row per block, which is all
that the driver holds. A page then follows from the counts: it reads the one or two blocks it lies in, no row before
them travels, and the total is known without another pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsreview.session import write_through

_BLOCK = "_block"


class Pages:
    """``order`` names columns, from the most important on; a leading ``-`` means descending. It must be unique, or rows that tie
    may change places between builds. Nulls come first, and last where descending."""

    def __init__(self, rows: DataFrame, order: Sequence[str], label: str = "pages", blocks: int | None = None) -> None:
        self.columns = rows.columns
        self._keys = [(name.lstrip("-"), name.startswith("-")) for name in order]
        self._sort = [F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_first() for name, down in self._keys]
        ranged = rows.repartitionByRange(blocks, *self._sort) if blocks else rows.repartitionByRange(*self._sort)
        ranged = ranged.withColumn(_BLOCK, F.spark_partition_id()).sortWithinPartitions(*self._sort)
        self._rows = write_through(ranged, label)
        counts = self._rows.groupBy(_BLOCK).agg(F.count("*").alias("n")).orderBy(_BLOCK)
        self._counts: list[tuple[int, int]] = [tuple(r) for r in counts.collect()]  # a row per block
        self.total = sum(n for _, n in self._counts)

    def _in_blocks(self, blocks: Sequence[int]) -> DataFrame:
        return self._rows.where(F.col(_BLOCK).isin(*blocks) if blocks else F.lit(False))

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` in order, with ``total``. Beyond the end there are none."""
        if limit < 1 or offset < 0:
            raise ValueError("limit must be positive and offset not negative")
        before, blocks, skipped = 0, [], 0
        for block, n in self._counts:
            if before + n <= offset:
                skipped = before + n
            elif before < offset + limit:
                blocks.append(block)
            before += n
        rows = self._in_blocks(blocks).orderBy(*self._sort).offset(offset - skipped if blocks else 0).limit(limit)
        return rows.select(*self.columns, F.lit(self.total).alias("total"))

    def after(self, last: Mapping[str, object], limit: int) -> DataFrame:
        """The ``limit`` rows that follow the row with these values of the order's columns, with ``total``."""
        if limit < 1:
            raise ValueError("limit must be positive")
        later = F.lit(False)
        for name, down in reversed(self._keys):
            here, value = F.col(name), last[name]
            if value is None:
                beyond = F.lit(False) if down else here.isNotNull()
            else:
                beyond = (here < F.lit(value)) | here.isNull() if down else here > F.lit(value)
            later = beyond | (here.eqNullSafe(F.lit(value)) & later)
        # Blocks that end before the row hold none of those wanted; of the others the first that fill the page are enough.
        counts = {r[0]: r[1] for r in self._rows.where(later).groupBy(_BLOCK).agg(F.count("*")).collect()}
        blocks, held = [], 0
        for block, _ in self._counts:
            if counts.get(block) and held < limit:
                blocks.append(block)
                held += counts[block]
        rows = self._in_blocks(blocks).where(later).orderBy(*self._sort).limit(limit)
        return rows.select(*self.columns, F.lit(self.total).alias("total"))
