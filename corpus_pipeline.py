"""The corpus pipeline: language ID, near duplicates, mixing of sources, tokens.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engramix.llm import bpe, jaccard, langid, mixing
from engramix.llm.shared import drop, keep


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; fitted to the labels of the same documents."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the production weights of their sources."""
    return mixing.mix_sources(docs, copy_column=None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left."""
    return bpe.encode_documents(docs, carry=("doc_id", "source"))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mixture),
    ("byte_bpe", tokens),
]

#: SQL can't express the language model; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
