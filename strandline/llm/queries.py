"""The registered queries of this subpackage: each reads its whole table and applies one operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import decontaminate, language_model, near_dup, oracle, packing, page_text, quality_model, quality_rules, repeats, secrets, sharding


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extracted(_read(spark, sf_dir, "pages"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_read(spark, sf_dir, "documents"), size=4, percent=80)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_read(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(_read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_read(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicated(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scans, op2_html_extraction, op3_near_duplicates, op4_packing, op5_quality_classifier, op6_decontamination, op7_language_model, op8_quality_rules, op9_sharding, op10_substring_dedup, pipeline)
}

#: SQL that DuckDB can run on the same tables; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op3_near_duplicates": oracle.OP3, "op6_decontamination": oracle.OP6, "op10_substring_dedup": oracle.OP10}
