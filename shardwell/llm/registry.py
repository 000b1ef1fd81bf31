"""Queries of this subpackage: each applies its operator, with production parameters, to its whole table and keeps the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwell.llm import ann, cleaning, extraction, katz, mixing, neardup, packing, passages, quality, toxicity
from shardwell.llm._common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


def op4_extract_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op8_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op9_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaning.clean(table(spark, sf_dir, "documents"), with_text=False)
    return out.drop("lines_failed")


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_mix_sources,
        op2_pack_best_fit,
        op3_toxicity,
        op4_extract_main_text,
        op5_quality_rules,
        op6_near_duplicates,
        op7_repeated_passages,
        op8_katz_scores,
        op9_clean_lines,
        op10_nearest_vectors,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express; the others are tested against brute force, round trips or held-out labels."""
    return {"op9_clean_lines": cleaning.ORACLE, "op10_nearest_vectors": ann.ORACLE}
