"""Uploaded CSV and JSON files as rows of text, and typed exports.

Nothing is inferred: every cell arrives as text and is converted under the dataset's
registry entry. Problems of a file as a whole come back as codes, not as exceptions.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsreview.schemas import DATASETS, GROUND_TRUTH, Dataset
from opsreview.session import write_through
from opsreview.sources.pieces import csv_records, json_elements, position

ROW = "_row"
_FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl"}


@dataclass(frozen=True)
class RawBatch:
    """Text rows of one dataset: the row number and the registry columns present.

    Names that the registry does not know are in ``unknown`` for a CSV header, and in the column
    ``field`` of ``unknown_names`` for JSON, where every record can bring new ones.
    """

    dataset: str
    fmt: str | None = None
    rows: DataFrame | None = None
    row_count: int = 0
    present: frozenset[str] = frozenset()
    unknown: tuple[str, ...] = ()
    unknown_names: DataFrame | None = None
    fatal: tuple[str, ...] = field(default=())


def format_of(path: str) -> str | None:
    """The format by file extension, ``None`` when it is not accepted."""
    for suffix, fmt in _FORMATS.items():
        if path.lower().endswith(suffix):
            return fmt
    return None


def read_batch(spark: SparkSession, dataset_type: str, path: str) -> RawBatch:
    """Read one upload of any size. ``fatal`` codes mean that its rows cannot be interpreted.

    Files are split over tasks, also a CSV file with line breaks inside quotes and a JSON document (see ``pieces``). One task parses a
    whole file only where that does not find its records: carriage returns mixed into CSV lines, or a JSON document that is
    not plainly a list of objects, which is refused anyway in most cases.
    """
    dataset = DATASETS.get(dataset_type)
    if dataset is None:
        return RawBatch(dataset_type, fatal=("unsupported_dataset_type",))
    fmt = format_of(path)
    if fmt is None:
        return RawBatch(dataset_type, fatal=("unsupported_format",))
    if not spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]:
        return RawBatch(dataset_type, fmt, fatal=("empty_dataset",))
    if not stretches(spark, path, fmt).where(~F.is_valid_utf8("value")).isEmpty():
        return RawBatch(dataset_type, fmt, fatal=("content_format_mismatch",))
    if fmt == "csv":
        return _read_csv(spark, dataset, path, spark.read.text(path))
    return _read_json(spark, dataset, path, fmt)


def stretches(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """The text of an upload in rows that need not be lines: a JSON document, which may be one line, is cut behind braces.

    A brace or line feed is a byte of its own in UTF-8, so a cut leaves valid text valid and other text not.
    """
    reader = spark.read.option("lineSep", "}") if fmt == "json" else spark.read
    return reader.text(path)


def _numbered(df: DataFrame) -> DataFrame:
    """Replace the file position by ``_row``: 1, 2, ... in file order.

    Row ids are consecutive within a file split; adding the sizes of earlier splits
    numbers the rows without moving them. There is one summary row per split.
    """
    landed = write_through(df, "landed")
    splits = landed.groupBy("_file", "_start").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    earlier = W.orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select("_file", "_start", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return (
        landed.join(offsets, ["_file", "_start"])
        .withColumn(ROW, F.col("_at") - F.col("first") + F.col("before") + 1)
        .drop("_file", "_start", "_at", "first", "before")
    )


def _read_csv(spark: SparkSession, dataset: Dataset, path: str, lines: DataFrame) -> RawBatch:
    first = lines.where(F.trim("value") != "").head()
    if first is None:
        return RawBatch(dataset.name, "csv", fatal=("malformed_csv",))
    if first[0].lstrip()[:1] in ("{", "["):
        return RawBatch(dataset.name, "csv", fatal=("content_format_mismatch",))
    # A record can only span lines if some line has an odd number of quotes; else files are split.
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    spans, every = lines.agg(F.bool_or(quotes % 2 == 1), F.sum(quotes)).first()
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "encoding": "UTF-8", "multiLine": bool(spans)}
    first_record = spark.read.options(header=False, **options).csv(path).head()
    header = [name if name is not None else f"_c{i}" for i, name in enumerate(first_record)]
    # Columns go by place, as names can repeat; of a repeated name the first column counts. One column
    # more than the header has is filled only by rows that are too long.
    places = [f"c{i}" for i in range(len(header) + 1)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in places])
    names = {f.name for f in dataset.fields}
    present: dict[str, int] = {}
    for i, name in enumerate(header):
        if name in names:
            present.setdefault(name, i)
    wanted = [*[F.col(f"c{i}").alias(name) for name, i in present.items()], F.col(places[-1]).isNotNull().alias("_bad")]
    found = csv_records(spark, path) if spans else None
    if found is not None:
        records, open_quote = found
        cells = records.select(ROW, F.from_csv("value", schema.simpleString()[len("struct<") : -1].replace(":", " "), {"quote": '"', "escape": '"'}).alias("cells"))
        rows = write_through(cells.select(ROW, "cells.*").select(ROW, *wanted), "landed").withColumn("_spans", F.lit(False))
    else:
        cells = spark.read.schema(schema).options(header=True, enforceSchema=True, **options).csv(path)
        rows = _numbered(cells.select(*wanted, F.contains(F.concat_ws("", *places), F.lit("\n")).alias("_spans"), *position()))
    count, bad, last_spans = rows.agg(F.count("*"), F.max("_bad"), F.max_by("_spans", ROW)).first()
    if found is None:  # a quote that never closes takes in the rest of the file
        open_quote = bool(last_spans) and every % 2 == 1
    return RawBatch(
        dataset.name, "csv", rows.drop("_bad", "_spans"), count, frozenset(present),
        tuple(dict.fromkeys(c for c in header if c not in names)),
        fatal=("malformed_csv",) if bad or open_quote else (),
    )


def _read_json(spark: SparkSession, dataset: Dataset, path: str, fmt: str) -> RawBatch:
    value = F.try_parse_json("value")
    found, balanced = json_elements(spark, path) if fmt == "json" else (None, True)
    if not balanced:
        return RawBatch(dataset.name, fmt, fatal=("malformed_json",))
    text = spark.read.text(path, wholetext=(fmt == "json")).where(F.trim("value") != "")
    if found is not None:
        elements = write_through(found.select(ROW, value.alias("element")), "json-elements")
        if not elements.where(F.col("element").isNull()).isEmpty():
            return RawBatch(dataset.name, fmt, fatal=("malformed_json",))
    elif fmt == "json":
        records = text.select(value.alias("doc"), F.col("_metadata.file_path").alias("_file")).withColumn(
            "list",
            F.coalesce(
                F.expr("try_cast(try_variant_get(doc, '$.records', 'variant') as array<variant>)"),
                F.expr("try_cast(doc as array<variant>)"),
            ),
        )
        broken = records.agg(F.max(F.col("doc").isNull()), F.max(F.col("list").isNull())).first()
        if broken[0] or broken[0] is None:
            return RawBatch(dataset.name, fmt, fatal=("malformed_json",))
        if broken[1]:
            return RawBatch(dataset.name, fmt, fatal=("invalid_json_structure",))
        elements = records.select("_file", F.lit(0).cast("bigint").alias("_start"), F.posexplode("list").alias("_at", "element"))
    else:
        elements = text.select(value.alias("element"), *position())
        if not elements.where(F.col("element").isNull()).isEmpty():
            return RawBatch(dataset.name, fmt, fatal=("malformed_json",))
    place = [F.col(ROW)] if found is not None else [F.col("_file"), F.col("_start"), F.col("_at").cast("bigint").alias("_at")]
    landed = elements.select(
        *place,
        (~F.schema_of_variant("element").startswith("OBJECT")).alias("_bad"),
        F.expr("transform_values(try_cast(element as map<string, variant>), (k, v) -> try_cast(v as string))").alias("cells"),
    )
    rows = write_through(landed, "landed") if found is not None else _numbered(landed)
    names = [f.name for f in dataset.fields]
    count, bad = rows.agg(F.count("*"), F.max("_bad")).first()
    if bad:
        return RawBatch(dataset.name, fmt, row_count=count, fatal=("invalid_json_structure",))
    seen = rows.agg(*[F.bool_or(F.map_contains_key("cells", F.lit(n))).alias(n) for n in names]).first()
    present = [n for n in names if seen[n]]
    keys = rows.select(F.explode(F.map_keys("cells")).alias("field"))
    return RawBatch(
        dataset.name, fmt,
        rows.select(ROW, *[F.try_element_at("cells", F.lit(n)).alias(n) for n in present]),
        count,
        frozenset(present),
        unknown_names=keys.where(~F.col("field").isin(names)).distinct(),
    )


# --- Exports ----------------------------------------------------------------------------


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in order and type; missing ones are NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def export(tables: Mapping[str, DataFrame], folder: str, ground_truth: DataFrame | None = None) -> DataFrame:
    """Write each table as CSV and as JSON Lines, and a manifest of row counts.

    Spark writes folders of part files; ``<table>.csv`` and ``<table>.jsonl`` are such
    folders and can be read back as uploads. Returns the manifest.
    """
    frames = {name: _typed(df, DATASETS[name].struct) for name, df in tables.items()}
    if ground_truth is not None:
        frames["ground_truth"] = _typed(ground_truth, GROUND_TRUTH)
    manifest = None
    for name, frame in frames.items():
        words = [
            F.initcap(F.col(f.name).cast("string")).alias(f.name) if isinstance(f.dataType, T.BooleanType) else F.col(f.name)
            for f in frame.schema
        ]
        frame.select(*words).write.option("header", True).option("escape", '"').option(
            "timestampFormat", "yyyy-MM-dd HH:mm:ssxxx"
        ).csv(f"{folder}/{name}.csv")
        frame.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").option("ignoreNullFields", False).json(f"{folder}/{name}.jsonl")
        count = frame.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        manifest = count if manifest is None else manifest.unionByName(count)
    manifest.coalesce(1).write.json(f"{folder}/manifest.json")
    return manifest
