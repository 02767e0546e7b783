"""Declared schemas of the record tables, their checks, and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "jobs": "id string, company string, title string, url string, location string, jd_text string, status string, source string, external_job_id string, applied_at timestamp, created_at timestamp",
    "resumes": "id string, job_id string, file_name string, storage_path string, extracted_text string, uploaded_at timestamp",
    "resume_chunks": "id string, resume_id string, job_id string, chunk_index int, chunk_text string, embedding array<float>, embedding_model string",
    "contacts": "id string, job_id string, name string, linkedin_url string, headline string, company string, persona string, status string, connected_at timestamp, accepted_at timestamp, last_checked_at timestamp, created_at timestamp, profile_text string, profile_read_at timestamp",
    "messages": "id string, contact_id string, job_id string, type string, draft_text string, sent_text string, sent_at timestamp, review struct<evidence_count:int,problems:array<string>,ungrounded_figures:array<string>,repair_passes:int>, created_at timestamp",
}


def schema_of(table: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[table])


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` and reasons, the names of the rules a row breaks; a rule that gives null counts as broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in sorted(rules.items())]
    return df.withColumn("reasons", F.array_compact(F.array(*broken)))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files, one a row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def replace_partitions(df: DataFrame, path: str, column: str) -> None:
    """Write ``df`` over the partitions of ``column`` that it has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
