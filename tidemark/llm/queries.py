"""Queries of the corpus operators, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import abuse, mixing, tokenizer
from tidemark.sources import table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.token_ids(table(spark, folder, "documents"))


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    counts = tokenizer.token_counts(table(spark, folder, "documents"), ["doc_id", "source"])
    return mixing.sized_documents(counts)


def _mixture(sized: DataFrame, targets: DataFrame) -> DataFrame:
    return mixing.mix(sized, mixing.plan(sized, targets, "all"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    sized = _sized(spark, folder)
    return _mixture(sized, table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    sized, targets = _sized(spark, folder), table(spark, folder, "mix_targets")
    return mixing.report(_mixture(sized, targets), sized, targets)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with an abusive, hateful or sexually explicit passage."""
    scored = abuse.score_documents(table(spark, folder, "documents"), ["doc_id"])
    return scored.where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every document."""
    return abuse.score_documents(table(spark, folder, "documents"), ["doc_id", "source"])


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, cases and rate of each source."""
    return (
        p8_scores(spark, folder)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("score") >= abuse.THRESHOLD).alias("found"))
        .withColumn("rate", F.round(F.col("found") / F.col("documents"), 6))
    )


QUERIES = {f.__name__: f for f in (p6_ids, p7_mix, p7_shares, p8_found, p8_scores, p8_rates)}
ORACLE: dict[str, str] = {}
