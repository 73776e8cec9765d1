"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, oracles, packing, pii, quality, simhash, substring, suffix, tokens, warc
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(chat.with_probe(table(spark, sf_dir, "conversations")))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_personal_data": op2_personal_data,
        "op3_mixture_packing": op3_mixture_packing,
        "op4_token_counts": op4_token_counts,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_suffix_array_dedup": op8_suffix_array_dedup,
        "op9_decontamination": op9_decontamination,
        "op10_warc_derivatives": op10_warc_derivatives,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
