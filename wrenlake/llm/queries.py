"""Queries of the subpackage, pN_... of problem N, and the SQL that some of them are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenlake.llm import boilerplate, knn, leakage, mixture, names, residue, segment, truncation
from wrenlake.session import read_table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.similar_pairs(read_table(spark, sf_dir, "resume_chunks"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.found(*[read_table(spark, sf_dir, t).select("company") for t in ("contacts", "jobs")])


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with its employer: one row a string instead of all pairs."""
    return names.entities(*[read_table(spark, sf_dir, t).select("company") for t in ("contacts", "jobs")])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = residue.found(read_table(spark, sf_dir, "scraped_profiles"), read_table(spark, sf_dir, "scraped_ats_jobs"))
    return out.select("source_table", "scrape_id")


def p3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar chunks of every hundredth chunk (by a hash of its id), by greedy search of the graph."""
    chunks = read_table(spark, sf_dir, "resume_chunks").select("id", "embedding_model", "embedding")
    heads, graph = knn.build_graph(chunks)
    hits = knn.search(chunks.where(F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(100)) == 0), chunks, heads, graph)
    return hits.select("query", "id", F.round("sim", 4).alias("sim"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.found(read_table(spark, sf_dir, "scraped_ats_jobs"), read_table(spark, sf_dir, "jobs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.found(read_table(spark, sf_dir, "scraped_profiles"), read_table(spark, sf_dir, "scraped_ats_jobs"))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.shares(read_table(spark, sf_dir, "scraped_profiles"), read_table(spark, sf_dir, "scraped_ats_jobs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.found(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_entities, p2_found, p3_found, p3_search, p4_found, p5_found, p5_shares, p6_found, p7_mix, p7_shares, p8_found)}


def oracle_sql() -> dict[str, str]:
    return {}
