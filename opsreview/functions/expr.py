"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsreview import vocab as V


def lookup(mapping: Mapping[str, object], col: Column | str) -> Column:
    """Value of a small literal map, NULL for unknown keys."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.create_map(*pairs)[F.col(col) if isinstance(col, str) else col]


def rank_in(levels: Iterable[str], col: Column | str) -> Column:
    """Position of a level in its ordered vocabulary, -1 for unknown ones."""
    ranks = {level: i for i, level in enumerate(levels)}
    return F.coalesce(lookup(ranks, col), F.lit(-1))


def severity_at_least(col: Column | str, minimum: str) -> Column:
    """Severity and criticality share one scale: LOW < MEDIUM < HIGH < CRITICAL.

    Written as a list of accepted values so that the filter reaches the scan.
    """
    accepted = V.SEVERITIES[V.SEVERITIES.index(minimum):]
    return (F.col(col) if isinstance(col, str) else col).isin(*accepted)


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Exact seconds from ``start`` to ``end``; works with and without time zone."""
    s, e = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return (e - s).cast("interval second").cast("decimal(18,6)").cast("double")


def hours_between(start: Column | str, end: Column | str) -> Column:
    return seconds_between(start, end) / F.lit(3600.0)


def period_label(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM")


def rate(numerator: Column, denominator: Column, default: float | None = None) -> Column:
    """A ratio of doubles that is NULL (or ``default``) where the denominator is 0."""
    value = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def round_half_even(value: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even.

    ``bround`` would round its shortest decimal spelling, and ``rint(value * scale)`` a product that
    was rounded before; both differ where the value lies just beside a tie. Here the value is
    split into two parts whose products with the scale are exact, so its distance from the
    rounded product is known exactly.
    """
    scale = F.lit(float(10**digits))
    wide = value * F.lit(134217729.0)  # 2^27 + 1: the upper half of the digits
    upper = wide - (wide - value)
    lower = value - upper
    near = F.rint(value * scale)
    off = (upper * scale - near) + lower * scale
    odd = near % 2 != 0
    moved = (
        F.when((off > 0.5) | ((off == 0.5) & odd), near + 1)
        .when((off < -0.5) | ((off == -0.5) & odd), near - 1)
        .otherwise(near)
    )
    return moved / scale


def short_hash(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def clamp_unit(col: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), col))


def step_level(levels: tuple[str, ...], col: Column, by: Column | int) -> Column:
    """Move ``col`` up or down its ordered vocabulary, stopping at the ends."""
    rank = rank_in(levels, col) + by
    bounded = F.greatest(F.lit(0), F.least(F.lit(len(levels) - 1), rank))
    return F.element_at(F.array(*[F.lit(x) for x in levels]), bounded + 1)


def without_repeats(conditions: Iterable[tuple[Column, str]]) -> list[tuple[Column, str]]:
    """The same conditions, where of those with one label only the first that holds does."""
    told: list[tuple[Column, str]] = []
    for condition, label in conditions:
        for earlier in [c for c, other in told if other == label]:
            condition = condition & ~F.coalesce(earlier, F.lit(False))
        told.append((condition, label))
    return told


def kept(*conditions: tuple[Column, str]) -> Column:
    """Array of the labels whose condition holds, in the order given, without repeats.

    Listed as one text and split again: functions over arrays are not compiled. Labels hold no comma.
    """
    listed = F.concat_ws(",", *[F.when(condition, F.lit(label)) for condition, label in without_repeats(conditions)])
    return F.when(listed == "", F.array().cast("array<string>")).otherwise(F.split(listed, ","))


# --- Action sequences as text: one letter per action type -----------------------
_LETTERS = {action: chr(ord("a") + i) for i, action in enumerate(V.ACTION_TYPES)}
_ACTIONS = {letter: action for action, letter in _LETTERS.items()}


def action_letter(col: Column | str) -> Column:
    """The letter of an action type. Unknown types stop the job: two of them must
    not look alike, and validated input has none."""
    known = lookup(_LETTERS, col)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown action type: "), col)))


def letters_of(actions: Iterable[str]) -> str:
    return "".join(_LETTERS[a] for a in actions)


def action_names(letters: Column | str) -> Column:
    """The array of action types behind a letter sequence."""
    col = F.col(letters) if isinstance(letters, str) else letters
    one_by_one = F.filter(F.split(col, ""), lambda x: x != "")
    return F.transform(one_by_one, lambda x: lookup(_ACTIONS, x))


def sequence_hash(letters: Column | str) -> Column:
    return short_hash(F.array_join(action_names(letters), "|"), 8)


def edit_distance_ratio(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance over the longer length; 0 when both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return rate(F.levenshtein(a, b), longer, default=0.0)


def similarity(a: Column | str, b: Column | str) -> Column:
    return F.lit(1.0) - edit_distance_ratio(a, b)
