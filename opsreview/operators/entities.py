"""Listing and lookup of organisations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGE = 200


def page(entities: DataFrame, limit: int = 20, after: str | None = None) -> DataFrame:
    """The next entities in id order, behind the id ``after``. The total is ``entities.count()``."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    rest = entities if after is None else entities.where(F.col("entity_id") > after)
    return rest.orderBy("entity_id").limit(limit)


def one(entities: DataFrame, entity_id: str) -> DataFrame:
    return entities.where(F.col("entity_id") == entity_id)
