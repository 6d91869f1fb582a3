"""Telemetry counted per asset and window, as files arrive.

The stream and its batch twin share one aggregation. A watermark bounds the state: a window is kept open until
``late`` after its end has been seen, then its row is written once and its state is dropped; later records of it are left out.
The file sink's own log and the checkpoint make a restart go on where the last run stopped, without repeating
or losing a window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from opsreview.schemas import DATASETS


@dataclass(frozen=True)
class RollupSettings:
    """``window``: length of a tumbling window; ``late``: how long after newer records one may still come;
    ``files``: files of a batch at most (null: all that are there)."""

    window: str = "1 day"
    late: str = "2 days"
    files: int | None = None


def rolled_up(telemetry: DataFrame, settings: RollupSettings | None = None) -> DataFrame:
    """``entity_id, asset_id, window_start, window_end, records, event_count, last_seen, silent_records`` of each asset
    and window of ``period_start``, for a table or a stream. Rows without a time are left out."""
    settings = settings or RollupSettings()
    window = F.window("period_start", settings.window)
    rows = telemetry.withColumn("period_start", F.col("period_start").cast("timestamp")).where(F.col("period_start").isNotNull())
    return (
        rows.withWatermark("period_start", settings.late)
        .groupBy("entity_id", "asset_id", window.alias("span"))
        .agg(
            F.count("*").alias("records"),
            F.sum("event_count").alias("event_count"),
            F.max("period_start").alias("last_seen"),
            F.count(F.when(F.col("event_count") == 0, 1)).alias("silent_records"),
        )
        .select("entity_id", "asset_id", F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "records", "event_count", "last_seen", "silent_records")
    )


def arriving(spark: SparkSession, folder: str, settings: RollupSettings | None = None) -> DataFrame:
    """Telemetry Parquet files of a folder as a stream, oldest first."""
    settings = settings or RollupSettings()
    reader = spark.readStream.schema(DATASETS["telemetry"].struct)
    if settings.files:
        reader = reader.option("maxFilesPerTrigger", settings.files)
    return reader.parquet(folder)


def start(spark: SparkSession, source: str, target: str, checkpoint: str, settings: RollupSettings | None = None) -> StreamingQuery:
    """Write closed windows of the files below ``source`` as Parquet below ``target``: all files that are there, then stop. Started
    again with the same ``checkpoint`` it takes the files that have come since. Folders must be shared by all executors."""
    rows = rolled_up(arriving(spark, source, settings), settings)
    return (
        rows.writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
