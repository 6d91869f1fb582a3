"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read back.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept. All but
the last return the columns of ``documents``; the last returns the rows of the token files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from opsreview.llm import decontaminate, mixing, near_dedup, token_files, toxicity
from opsreview.llm.tables import DOCUMENT_COLUMNS, table
from opsreview.session import shared_folder


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above the toxicity threshold go. The model learns from the labelled documents among ``docs``."""
    return toxicity.without_toxic(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return near_dedup.deduplicated(docs.select(*DOCUMENT_COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, as it is or with other numbers, names or units, go."""
    return decontaminate.clean(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"), decontaminate.DecontaminationSettings(short_items=True))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: not at all, once or twice."""
    return mixing.mix(docs.select(*DOCUMENT_COLUMNS))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: ``doc_id, start, n_tokens, ids_crc32``."""
    return token_files.written_and_read(docs.select("doc_id", "text")).drop("ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]

#: SQL cannot train the toxicity model, walk the cube or tokenize; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/opsreview-{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
