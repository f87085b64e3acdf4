"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import chat_format, decontaminate, host_rules, html_layout, line_dedup, mixing, ngram_join, quality, sharding, suffix_dedup
from vellum.llm.tables import table


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(table(spark, sf_dir, "pages").select("page_id", "html"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.line_dedup(table(spark, sf_dir, "documents")))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.digest(host_rules.host_rules(table(spark, sf_dir, "documents")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")))


def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix_sources(table(spark, sf_dir, "documents")))


def op9_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(chat_format.format_preferences(chat_format.shortened_reply_pairs(table(spark, sf_dir, "conversations"))))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.digest(ngram_join.ngram_join(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_crf, op2_extendible_shards, op3_html_layout, op4_decontaminate, op5_line_dedup, op6_host_rules, op7_suffix_dedup, op8_entropy_mix, op9_preference_pairs, op10_ngram_join)}


def oracle_sql() -> dict[str, str]:
    return {"op2_extendible_shards": sharding.ORACLE, "op4_decontaminate": decontaminate.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op6_host_rules": host_rules.ORACLE, "op7_suffix_dedup": suffix_dedup.ORACLE, "op8_entropy_mix": mixing.ORACLE, "op9_preference_pairs": chat_format.ORACLE, "op10_ngram_join": ngram_join.ORACLE}
