"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "opsreview") -> SparkSession:
    """A session for one machine. On a cluster, bring your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        # Small local inputs should still use all cores after a shuffle.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A temporary folder is taken only where the setting is missing and Spark runs
    on one machine; on a cluster that would lose data, so it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="opsreview-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_folder(spark)}/opsreview-{spark.sparkContext.applicationId}"


def drop_intermediate(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. Results that were not written elsewhere are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_through(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    This cuts the lineage, so a lost executor costs a re-read rather than a
    recomputation, and it fixes values that depend on how the job was split. All
    tables of an application lie in one folder, to be dropped when it is done.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_each(frames: Mapping[str, DataFrame], at_once: int = 4) -> dict[str, DataFrame]:
    """Write several independent tables through, a few at a time, so that small jobs overlap."""
    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(frames, pool.map(lambda item: write_through(item[1], item[0]), frames.items()), strict=True))
