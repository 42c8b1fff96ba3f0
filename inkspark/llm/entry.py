"""Queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkspark.llm.clusters import clusters, clusters_sql
from inkspark.llm.common import table
from inkspark.llm.conversations import repaired
from inkspark.llm.decontaminate import contaminated
from inkspark.llm.html_text import main_text
from inkspark.llm.language import languages
from inkspark.llm.licences import licences
from inkspark.llm.line_dedup import line_dedup, line_dedup_sql
from inkspark.llm.minhash import near_components, near_components_sql
from inkspark.llm.mixing import mix, mix_sql
from inkspark.llm.personal import personal_data
from inkspark.llm.quality import quality, quality_sql
from inkspark.llm.simhash import near_groups
from inkspark.llm.token_count import token_counts


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "copies", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


QUERIES = [
    op1_quality_rules, op2_main_text, op3_line_dedup, op4_source_mixing, op5_simhash,
    op6_personal_data, op7_decontamination, op8_language, op9_token_count, op10_licences,
    op11_minhash, op12_conversation_repair, op13_centroid_clusters,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_sql(), "op3_line_dedup": line_dedup_sql(), "op4_source_mixing": mix_sql(),
        "op11_minhash": near_components_sql(), "op13_centroid_clusters": clusters_sql(),
    }
