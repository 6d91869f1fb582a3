"""The training-data queries by name, each over its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsreview.llm import align, bpe, decontaminate, exact_dedup, language, licenses, merkle, mixing, near_dedup, quality, token_files, toxicity, urls
from opsreview.llm.tables import held_out, table


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.deduplicated(table(spark, folder, "documents").select("doc_id", "text"))


def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    settings = near_dedup.NearSettings(shingle=3, percent=85)
    return near_dedup.grouped(table(spark, folder, "documents").select("doc_id", "text"), settings)


def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scanned(table(spark, folder, "documents").select("doc_id", "text"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    found = language.identified(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judged(table(spark, folder, "pages").select("page_id", "url"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    found = quality.scored(documents, table(spark, folder, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score", "text_score", "page_score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.written_and_read(table(spark, folder, "documents").select("doc_id", "text")).drop("ids")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    settings = toxicity.ToxicitySettings()
    found = toxicity.scored(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"), settings)
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= settings.threshold).cast("int").alias("predicted"),
    )


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mixed(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.judged(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"), decontaminate.DecontaminationSettings(short_items=True))


def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents").select("doc_id", "text"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every row held against a copy that lacks line breaks where 2 divides the CRC-32 of its id."""
    documents = table(spark, folder, "documents")
    return merkle.manifest(documents, merkle.without_line_breaks(F.col("text"), F.col("doc_id")))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align.counted(table(spark, folder, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_licenses": op3_licenses,
    "op4_language": op4_language,
    "op5_urls": op5_urls,
    "op6_quality": op6_quality,
    "op7_token_files": op7_token_files,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_alignment": op13_alignment,
}

ORACLE: dict[str, str] = {
    "op1_exact_dedup": """
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm, length(coalesce(text, '')) AS points
  FROM documents),
g AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op3_licenses": licenses.scanned_sql(),
    "op5_urls": urls.judged_sql(),
    "op12_merkle_manifest": merkle.tampered_sql(),
}
