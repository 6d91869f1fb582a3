"""Checks of text rows against the registry, with one report row per problem."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsreview import vocab as V
from opsreview.functions.expr import lookup
from opsreview.operators.keyfilter import KeyFilter, stored_among
from opsreview.schemas import DATASETS, Dataset, Field
from opsreview.session import write_through
from opsreview.sources.files import ROW, RawBatch

ISSUE = "code string, severity string, row bigint, field string, message string"
_MESSAGES = {
    "unsupported_format": "files must be .csv, .json or .jsonl",
    "unsupported_dataset_type": "there is no such dataset type",
    "malformed_csv": "the file cannot be read as CSV",
    "malformed_json": "the file cannot be read as JSON",
    "invalid_json_structure": "expected a list of objects, or an object with such a list under 'records'",
    "empty_dataset": "there are no records",
    "missing_required_column": "a required column is missing",
    "unknown_column": "the column is not part of the dataset",
    "invalid_field_type": "the value does not have the column's type",
    "content_format_mismatch": "the content does not fit the file extension",
    "missing_required_value": "a required value is missing",
    "invalid_enum_value": "the value is not in the column's vocabulary",
    "invalid_identifier_format": "the identifier does not have the expected form",
    "invalid_timestamp": "the value is not an ISO-8601 time stamp",
    "naive_timestamp": "the time stamp has no zone",
    "value_out_of_range": "the value is outside the allowed range",
    "negative_value": "the value must not be negative",
    "temporal_order": "the time stamp lies before the one it must follow",
    "duplicate_identifier": "the identifier occurs more than once or is already stored",
    "duplicate_unique_value": "the value must be unique and occurs more than once or is already stored",
    "missing_reference": "the record referred to does not exist",
}
_WHITESPACE = " \t\n\r\f\v"
_INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_TIME = (
    r"^([0-9]{4}-[0-9]{2}-[0-9]{2})"
    r"(?:[T ]([0-9]{2}:[0-9]{2})(:[0-9]{2})?([.,][0-9]+)?(Z|z|[+-][0-9]{2}(?::?[0-9]{2})?)?)?$"
)


@dataclass(frozen=True)
class Validation:
    """Outcome of one check run. ``issues`` and ``accepted`` stay distributed."""

    dataset: str
    fmt: str | None
    issues: DataFrame
    accepted: DataFrame | None
    row_count: int
    accepted_count: int
    error_count: int
    structural_count: int

    @property
    def semantic_count(self) -> int:
        return self.error_count - self.structural_count

    @property
    def rejected_count(self) -> int:
        return self.row_count - self.accepted_count

    @property
    def is_valid(self) -> bool:
        return self.error_count == 0

    def detail(self, cap: int = 100) -> DataFrame:
        """The first problems in row order; the counts above cover all of them."""
        return self.issues.orderBy(F.col("row").asc_nulls_first(), "field", "code").limit(cap)


def _text(col: str) -> Column:
    return F.nullif(F.trim(F.col(col), F.lit(_WHITESPACE)), F.lit(""))


def _times(texts: Column) -> Column:
    """For each time stamp of an array of texts: ``at``, its instant, taken as UTC without a zone, and whether it is ``zoned``."""

    def instant(parts: Column) -> Column:
        date, time, seconds, fraction, zone = (F.nullif(F.get(parts, F.lit(i)), F.lit("")) for i in range(5))
        offset = F.regexp_replace(F.regexp_replace(F.upper(zone), r"^([+-]\d\d)$", "$1:00"), r"^([+-]\d\d)(\d\d)$", "$1:$2")
        spelled = F.concat(
            date, F.lit("T"), F.coalesce(time, F.lit("00:00")), F.coalesce(seconds, F.lit(":00")),
            F.coalesce(F.replace(fraction, F.lit(","), F.lit(".")), F.lit("")), F.coalesce(offset, F.lit("Z")),
        )
        return F.struct(spelled.try_cast("timestamp").alias("at"), zone.isNotNull().alias("zoned"))

    parts = F.transform(texts, lambda t: F.when(t.rlike(_TIME), F.split(F.regexp_replace(t, _TIME, "$1|$2|$3|$4|$5|"), r"\|")))
    return F.transform(parts, instant)


def _value(field: Field, assume_utc: bool) -> Column:
    """The typed value, NULL when the text does not convert. That of a time stamp is in ``_at_<name>`` and ``_zoned_<name>``."""
    text = F.col(field.name)
    if field.kind == "string":
        return text
    if field.kind == "enum":
        word = F.upper(text)
        return F.when(word.isin(*field.values), word)
    if field.kind == "timestamp":
        instant = F.col(f"_at_{field.name}")
        return instant if assume_utc else F.when(F.col(f"_zoned_{field.name}"), instant)
    if field.kind == "boolean":
        word = F.lower(text)
        return F.when(word.isin(*V.TRUE_WORDS), F.lit(True)).when(word.isin(*V.FALSE_WORDS), F.lit(False))
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    if field.kind == "float":
        return F.when(F.abs(number) < F.lit(float("inf")), number)
    plain = F.regexp_replace(text, "_", "").try_cast("bigint")
    return F.when(text.rlike(_INTEGER), plain).when(F.rint(number) == number, number.try_cast("bigint"))


def _problems(field: Field, assume_utc: bool) -> list[tuple[Column, str]]:
    """What may be wrong with the conversion of a text."""
    text, value = F.col(field.name), F.col(f"_value_{field.name}")
    if field.kind == "string":
        return []
    if field.kind == "timestamp":
        instant = F.col(f"_at_{field.name}")
        problems = [(text.isNotNull() & instant.isNull(), "invalid_timestamp")]
        return problems if assume_utc else [*problems, (instant.isNotNull() & value.isNull(), "naive_timestamp")]
    return [(text.isNotNull() & value.isNull(), "invalid_enum_value" if field.kind == "enum" else "invalid_field_type")]


def check_cells(rows: DataFrame, dataset: Dataset, assume_utc: bool = False) -> DataFrame:
    """``_row``, the typed columns, and ``_issues``: the problems seen within each row.

    Texts, time stamps, values and problems are steps of their own: several problems look at the same value,
    and what is a column already is not worked out again for each of them.
    """
    texts = rows.select(
        ROW, *[(_text(f.name) if f.name in rows.columns else F.lit(None).cast("string")).alias(f.name) for f in dataset.fields]
    )
    times = [f.name for f in dataset.fields if f.kind == "timestamp"]
    cells = texts.withColumn("_times", _times(F.array(*[F.col(n) for n in times]).cast("array<string>")))
    cells = cells.select(
        "*", *[F.get("_times", F.lit(i))[part].alias(f"_{part}_{n}") for i, n in enumerate(times) for part in ("at", "zoned")]
    ).drop("_times")
    cells = cells.select("*", *[_value(f, assume_utc).alias(f"_value_{f.name}") for f in dataset.fields])
    values = {f.name: F.col(f"_value_{f.name}") for f in dataset.fields}
    found: list[tuple[Column, str, str]] = []
    for f in dataset.fields:
        text = F.col(f.name)
        found += [(condition, code, f.name) for condition, code in _problems(f, assume_utc)]
        if not f.optional:
            found.append((text.isNull(), "missing_required_value", f.name))
        if f.id_pattern:
            found.append((~text.rlike(f.id_pattern), "invalid_identifier_format", f.name))
        if f.minimum is not None:
            code = "negative_value" if f.minimum == 0 else "value_out_of_range"
            found.append((values[f.name] < F.lit(f.minimum), code, f.name))
        if f.maximum is not None:
            found.append((values[f.name] > F.lit(f.maximum), "value_out_of_range", f.name))
    for earlier, later in dataset.ordered:
        found.append((values[later] < values[earlier], "temporal_order", later))
    marks = F.concat_ws(" ", *[F.when(condition, F.lit(f"{code}:{name}")) for condition, code, name in found])
    marked = cells.select(ROW, *[values[f.name].alias(f.name) for f in dataset.fields], marks.alias("_marks"))
    issues = F.transform(
        F.split("_marks", " "),
        lambda mark: F.struct(F.split_part(mark, F.lit(":"), F.lit(1)).alias("code"), F.split_part(mark, F.lit(":"), F.lit(2)).alias("field")),
    )
    none = F.array().cast("array<struct<code: string, field: string>>")
    return marked.select(ROW, *[f.name for f in dataset.fields], F.when(F.col("_marks") == "", none).otherwise(issues).alias("_issues"))


def _repeats(typed: DataFrame, column: str) -> DataFrame:
    """Rows whose value already occurred in an earlier row.

    The first row of each value comes from a mergeable minimum, and all others are
    found by row number, which is unique; a value of any frequency is no hot key.
    """
    rows = typed.where(F.col(column).isNotNull()).select(ROW, column)
    firsts = rows.groupBy(column).agg(F.min(ROW).alias(ROW)).select(ROW)
    return rows.join(firsts, ROW, "left_anti").select(ROW)


def _stored(typed: DataFrame, column: str, existing: DataFrame, keys: KeyFilter | None = None) -> DataFrame:
    """Rows whose value is already stored."""
    known = existing.select(column) if keys is None else stored_among(typed, column, existing, column, keys)
    return typed.select(ROW, column).join(known, column, "left_semi").select(ROW)


def _dangling(typed: DataFrame, column: str, known: DataFrame, key: str, keys: KeyFilter | None = None) -> DataFrame:
    """Rows that refer to something unknown; distinct values are looked up first."""
    values = typed.where(F.col(column).isNotNull()).select(column)
    found = known.select(F.col(key).alias(column)) if keys is None else stored_among(values, column, known, key, keys)
    unknown = values.distinct().join(found, column, "left_anti")
    return typed.select(ROW, column).join(unknown, column, "left_semi").select(ROW)


def _as_issues(rows: DataFrame, code: str, column: str) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), ROW, F.lit(column).alias("field"))


def row_issues(
    typed: DataFrame,
    dataset: Dataset,
    references: Mapping[str, DataFrame] | None = None,
    existing: DataFrame | None = None,
    mode: str = "APPEND",
    filters: Mapping[tuple[str, str], KeyFilter] | None = None,
) -> DataFrame:
    """All problems of typed rows: ``code, severity, row, field, message``.

    ``references`` holds the tables referred to; a table that is absent is not
    checked. ``existing`` is the stored table, consulted in APPEND mode. ``filters``
    by dataset and column tell which values need not be looked up; they change no result.
    """
    filters = filters or {}
    parts = [typed.select(F.explode("_issues").alias("i"), ROW).select("i.code", ROW, "i.field")]
    unique = [(dataset.key, "duplicate_identifier")] + [(c, "duplicate_unique_value") for c in dataset.unique]
    for column, code in unique:
        parts.append(_as_issues(_repeats(typed, column), code, column))
        if mode == "APPEND" and existing is not None:
            parts.append(_as_issues(_stored(typed, column, existing, filters.get((dataset.name, column))), code, column))
    for f in dataset.fields:
        if f.references and references and f.references in references:
            target = DATASETS[f.references]
            keys = filters.get((target.name, target.key))
            parts.append(_as_issues(_dangling(typed, f.name, references[f.references], target.key, keys), "missing_reference", f.name))
    issues = parts[0]
    for part in parts[1:]:
        issues = issues.unionByName(part)
    return issues.select(
        "code",
        F.when(F.col("code").isin(*V.STRUCTURAL_CODES), "structural").otherwise("semantic").alias("severity"),
        F.col(ROW).alias("row"),
        "field",
        lookup(_MESSAGES, "code").alias("message"),
    )


def structure_issues(spark: SparkSession, batch: RawBatch) -> DataFrame:
    """Problems of the file as a whole and of its columns."""
    found = [(code, None) for code in batch.fatal]
    dataset = DATASETS.get(batch.dataset)
    if not batch.fatal and dataset is not None:
        found += [("missing_required_column", c) for c in dataset.required_columns if c not in batch.present]
        found += [("unknown_column", c) for c in batch.unknown]
        if batch.row_count == 0:
            found.append(("empty_dataset", None))
    issues = spark.createDataFrame([(code, "structural", None, name, _MESSAGES[code]) for code, name in found], ISSUE)
    if batch.fatal or batch.unknown_names is None:
        return issues
    named = batch.unknown_names.select(
        F.lit("unknown_column").alias("code"), F.lit("structural").alias("severity"), F.lit(None).cast("long").alias("row"),
        "field", F.lit(_MESSAGES["unknown_column"]).alias("message"),
    )
    return issues.unionByName(named)


def validate(
    spark: SparkSession,
    batch: RawBatch,
    references: Mapping[str, DataFrame] | None = None,
    existing: DataFrame | None = None,
    mode: str = "APPEND",
    assume_utc: bool = False,
    filters: Mapping[tuple[str, str], KeyFilter] | None = None,
) -> Validation:
    """Check one batch. Structural problems stop before rows are looked at."""
    if mode not in V.IMPORT_MODES:
        raise ValueError(f"mode must be one of {V.IMPORT_MODES}")
    structural = structure_issues(spark, batch)
    n_structural = structural.count()
    if n_structural:
        return Validation(batch.dataset, batch.fmt, structural, None, batch.row_count, 0, n_structural, n_structural)
    dataset = DATASETS[batch.dataset]
    typed = write_through(check_cells(batch.rows, dataset, assume_utc), "typed-rows")
    issues = write_through(row_issues(typed, dataset, references, existing, mode, filters), "issues")
    counts = issues.agg(
        F.count("*").alias("all"),
        F.count(F.when(F.col("severity") == "structural", 1)).alias("structural"),
        F.countDistinct("row").alias("rows"),
    ).first()
    bad = issues.select(F.col("row").alias(ROW)).distinct()
    accepted = typed.join(bad, ROW, "left_anti").drop("_issues", ROW)
    return Validation(
        batch.dataset, batch.fmt, issues, accepted, batch.row_count, batch.row_count - counts["rows"],
        counts["all"], counts["structural"],
    )
