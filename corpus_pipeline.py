"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultmatch.llm import language, packing, quality, simhash, substrings
from faultmatch.llm.common import table, written
from faultmatch.llm.queries import vocabulary

#: Ids of a sequence, and the id that ends a document.
CAPACITY, END_ID = 4096, 1
#: Words of a shingle in the near-duplicate stage.
SHINGLE = 3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones teach; texts without letters and those far from all go."""
    return language.in_known_language(docs, language.learn(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and lie in their language's band of perplexity."""
    return quality.good_documents(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose fingerprints link at 2 bits or fewer, the one with the least id."""
    return simhash.one_of_each(docs, SHINGLE)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of 13 words and more that a document with a smaller id has too."""
    return substrings.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their places in sequences."""
    return packing.op4(docs, vocabulary("word_bpe_49k.json"), END_ID, CAPACITY)


STAGES = [
    ("language_id", known_language),
    ("quality_rules", good_quality),
    ("simhash_near_dedup", one_of_each),
    ("substring_dedup", without_repeats),
    ("best_fit_packing", packed),
]
#: SQL expresses neither the profiles nor the perplexity model; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
