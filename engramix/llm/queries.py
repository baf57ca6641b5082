"""The queries of this package, with their DuckDB oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, html_text, jaccard, katz, langid, media, mixing, neighbours, sharding, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, repeated to the production weights of their sources."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, calibrated confidence and rejection of every document."""
    return langid.identify(_table(spark, sf_dir, "documents"), carry=("doc_id", "lang"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page, laid out."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document; copies stay together."""
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op5_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the Katz model of all documents."""
    return katz.score(_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again to check the round trip."""
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates and number of links of every document."""
    return jaccard.near_classes(_table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others, among all embeddings, of each whose id is divisible by 100."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 100 == 0)


def op9_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of a seekable bundle: the index, checked by reading through it."""
    return warc.bundle_pages(_table(spark, sf_dir, "pages"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a member of an archive, read through the data source."""
    return media.page_media(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_language_id": op2_language_id,
    "op3_html_text": op3_html_text,
    "op4_shards": op4_shards,
    "op5_katz_scores": op5_katz_scores,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_warc_bundles": op9_warc_bundles,
    "op10_media_columns": op10_media_columns,
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.oracle(),
    "op4_shards": sharding.oracle(),
    "op5_katz_scores": katz.oracle(),
    "op7_ngram_jaccard": jaccard.oracle(),
    "op9_warc_bundles": warc.oracle(),
    "op10_media_columns": media.oracle(),
}
