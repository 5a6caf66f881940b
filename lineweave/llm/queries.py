"""The registered queries of the training-data operators, each over its whole table, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import containment, licences, mixing, projection, quality, quotes, setsketch, substrings, toxicity, warc
from .common import load


def op1_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality.scored(spark, docs, quality.fit(docs, load(spark, sf_dir, "labels")))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked(spark, load(spark, sf_dir, "conversations"))


def quotes_in_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second operator over a table with quotes, which the given conversations do not have."""
    return quotes.linked(spark, quotes.replies(load(spark, sf_dir, "conversations")))


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, load(spark, sf_dir, "pages")).drop("url")


def op4_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.scored(spark, docs, toxicity.fit(spark, docs, load(spark, sf_dir, "labels")))


def op5_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(spark, load(spark, sf_dir, "documents"), k=2)


def op6_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op7_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.near_vectors(spark, load(spark, sf_dir, "embeddings"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, load(spark, sf_dir, "documents"))


def op9_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(spark, load(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(spark, load(spark, sf_dir, "documents")).drop("kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_compression, op2_quotation_linking, op3_warc_bundles, op4_toxicity_lexicon, op5_setsketch_near_dedup, op6_benchmark_containment, op7_sorted_projections, op8_source_mixing, op9_licence_rules, op10_substring_dedup, quotes_in_replies)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quotation_linking": quotes.oracle(),
        "quotes_in_replies": quotes.oracle(quotes.REPLIES),
        "op3_warc_bundles": warc.ORACLE,
        "op5_setsketch_near_dedup": setsketch.ORACLE,
        "op6_benchmark_containment": containment.ORACLE,
        "op7_sorted_projections": projection.ORACLE,
        "op8_source_mixing": mixing.ORACLE,
        "op9_licence_rules": licences.oracle(),
        "op10_substring_dedup": substrings.ORACLE,
    }
