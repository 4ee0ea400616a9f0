"""Registered queries of the numbered operators over their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultmatch.llm import binary, chat, counts, html, language, merkle, packing, pairs, quality, sampling, simhash, spelling, substrings
from faultmatch.llm.common import table


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; never a copy in this repository."""
    return importlib.import_module("public_tokenizers").path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op2(table(spark, sf_dir, "conversations"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.op3(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op4(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1, 4096)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op5(table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op6(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.op7(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op8(table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.op9(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.op10(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op11(table(spark, sf_dir, "documents"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.op12(table(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.op13(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1,
    "op2_chat_format": op2,
    "op3_byte_pairs": op3,
    "op4_best_fit_packing": op4,
    "op5_simhash_groups": op5,
    "op6_language_id": op6,
    "op7_weighted_fingerprints": op7,
    "op8_quality_rules": op8,
    "op9_token_files": op9,
    "op10_substring_dedup": op10,
    "op11_merkle_manifest": op11,
    "op12_spelling_forms": op12,
    "op13_token_counts": op13,
}
SQL: dict[str, str] = {
    "op2_chat_format": chat.SQL,
    "op11_merkle_manifest": merkle.SQL,
}
