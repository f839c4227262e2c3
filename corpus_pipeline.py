"""A corpus pipeline of four stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderlens.llm import common, langid, mixing, pieces, shingles, tokens


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; others go."""
    return langid.accepted_documents(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similar word shingles join."""
    return shingles.distinct_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them; those it doesn't take go."""
    return mixing.curriculum(docs)


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled pieces of each document."""
    return pieces.sampled(docs, tokens.vocabulary("piece_bpe_32k.model"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [("language", language), ("distinct", distinct), ("mixture", mixture), ("segmented", segmented)]

#: Trigram models, Jaccard joins and sampling aren't SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
