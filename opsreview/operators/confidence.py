"""How well a finding is supported by records: factors, level, note.

Confidence speaks of the amount of data behind a finding, never of its weight.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsreview import vocab as V
from opsreview.functions.expr import kept, without_repeats

Labelled = list[tuple[Column, str]]


def record_factors(direct: Column) -> Labelled:
    return [
        (direct >= 3, "MULTIPLE_DIRECT_RECORDS"),
        (direct == 1, "SINGLE_RECORD"),
        (direct == 2, "ADEQUATE_RECORD_COUNT"),
    ]


def baseline_factors(n: Column, adequate: int = 3, large: int = 6, fragile: Column | None = None) -> Labelled:
    known = n > 0
    weak = F.lit(False) if fragile is None else fragile
    return [
        (known & weak, "FRAGILE_BASELINE"),
        (known & ~weak & (n < adequate), "SMALL_BASELINE"),
        (known & ~weak & (n >= adequate) & (n >= large), "LARGE_COMPARISON_POP"),
        (known & ~weak & (n >= adequate) & (n < large), "MODERATE_BASELINE"),
    ]


def period_factors(n: Column, adequate: int = 4) -> Labelled:
    return [((n > 0) & (n < adequate), "INSUFFICIENT_PERIODS")]


def always(label: str) -> Labelled:
    return [(F.lit(True), label)]


def has_any(factors: Column, labels: tuple[str, ...]) -> Column:
    return F.arrays_overlap(factors, F.array(*[F.lit(x) for x in labels]))


def level(factors: Column, refs: Column, absences: Column) -> Column:
    """The level that factors and references allow: the weakest factor decides."""
    return (
        F.when(refs <= absences, "LOW")
        .when(has_any(factors, V.LOW_FACTORS), "LOW")
        .when(F.array_contains(factors, "ABSENCE_BASED"), "MODERATE")
        .when(has_any(factors, V.MODERATE_FACTORS), "MODERATE")
        .otherwise("HIGH")
    )


def _holds(factors: Labelled, labels: tuple[str, ...]) -> Column:
    """Whether one of the factors with these labels holds, an unknown one taken for no."""
    return F.coalesce(reduce(or_, [condition for condition, label in factors if label in labels], F.lit(False)), F.lit(False))


def level_of(factors: Labelled, refs: Column, absences: Column) -> Column:
    """:func:`level` from the conditions themselves, without an array per finding."""
    return (
        F.when(refs <= absences, "LOW")
        .when(_holds(factors, V.LOW_FACTORS), "LOW")
        .when(_holds(factors, ("ABSENCE_BASED", *V.MODERATE_FACTORS)), "MODERATE")
        .otherwise("HIGH")
    )


def note(confidence: Column, factors: Labelled, direct: Column) -> Column:
    limiting = [(c, label) for c, label in without_repeats(factors) if label in (*V.LOW_FACTORS, *V.MODERATE_FACTORS)]
    listed = F.concat_ws("; ", *[F.when(c, F.lit(label.replace("_", " ").lower())) for c, label in limiting])
    named = F.when(listed == "", "small gaps in the data").otherwise(F.substring_index(listed, "; ", 3))
    return (
        F.when(confidence == "HIGH", F.concat(F.lit("Rests on "), F.coalesce(direct.cast("string"), F.lit("null")), F.lit(" source records without notable gaps.")))
        .when(confidence == "MODERATE", F.concat(F.lit("Supported by records, within limits: "), named, F.lit(".")))
        .otherwise(F.concat(F.lit("Thinly supported: "), named, F.lit(". Take it as a first pointer.")))
    )


def annotate(
    findings: DataFrame,
    factors: Labelled,
    direct: Column,
    refs: Column,
    absences: Column,
    native: str | None = None,
) -> DataFrame:
    """Add ``confidence``, ``confidence_factors``, ``confidence_note``, ``evidence_count``.

    ``refs`` counts the references of the finding from its own columns, so no join
    with the reference rows is needed. Detectors that judge their own confidence
    keep it (``native``); factors then only explain it.
    """
    refs, direct, absences = (c.cast("bigint") for c in (refs, direct, absences))
    confidence = F.col(native) if native else level_of(factors, refs, absences)
    return findings.select(
        *[c for c in findings.columns if c not in ("confidence", "confidence_note")],
        confidence.alias("confidence"),
        kept(*factors).alias("confidence_factors"),
        note(confidence, factors, direct).alias("confidence_note"),
        refs.alias("evidence_count"),
    )
