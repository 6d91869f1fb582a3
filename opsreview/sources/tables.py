"""The nine stored tables as one bundle, with an optional entity scope."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsreview.schemas import DATASETS

NAMES = tuple(DATASETS)
_WITH_ENTITY = tuple(n for n, d in DATASETS.items() if any(f.name == "entity_id" for f in d.fields))


class Tables:
    """Tables by name. A source may be a function; it is called on first use, so a
    query builds only the tables it reads."""

    def __init__(self, **sources: DataFrame | Callable[[], DataFrame]) -> None:
        missing = set(NAMES) - set(sources)
        if missing or set(sources) - set(NAMES):
            raise ValueError(f"tables must be exactly {NAMES}")
        self._sources = dict(sources)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._sources:
            raise AttributeError(name)
        source = self._sources[name]
        if not isinstance(source, DataFrame):
            source = self._sources[name] = source()
        return source

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Tables:
        """Read ``<folder>/<table>`` Parquet folders."""
        return cls(**{n: (lambda n=n: spark.read.parquet(f"{folder}/{n}")) for n in NAMES})

    def items(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in NAMES}

    def replace(self, **changed: DataFrame | Callable[[], DataFrame]) -> Tables:
        return Tables(**{n: changed.get(n, lambda n=n: getattr(self, n)) for n in NAMES})

    def scoped(self, entity_ids: Iterable[str] | DataFrame | None) -> Tables:
        """Restrict to some entities: ``None`` keeps all, an empty list keeps none.

        A list becomes an ``IN`` filter that reaches the scans; a DataFrame with
        ``entity_id`` becomes a semi join. Actions, escalations and remediations
        carry no entity; they follow through their joins.
        """
        if entity_ids is None:
            return self
        if isinstance(entity_ids, DataFrame):
            ids = entity_ids.select("entity_id")

            def limit(df: DataFrame) -> DataFrame:
                return df.join(ids, "entity_id", "left_semi")
        else:
            wanted = list(entity_ids)

            def limit(df: DataFrame) -> DataFrame:
                return df.where(F.col("entity_id").isin(wanted) if wanted else F.lit(False))

        return self.replace(**{n: (lambda n=n: limit(getattr(self, n))) for n in _WITH_ENTITY})
