"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.docs_pairs import pairs
from codeloom.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "documents"), with_code=False).select("symbol_key")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs themselves: description and code of each described function."""
    return pairs(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "documents")).select("symbol_key", "name", "kind", "description", "code")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of functions and methods with a real description, per repository and kind."""
    symbols = table(spark, sf_dir, "symbols")
    s = symbols.where(F.col("kind").isin("function", "method")).groupBy("symbol_key").agg(F.min("repo").alias("repo"), F.min("kind").alias("kind"))
    found = p3_found(spark, sf_dir).withColumn("described", F.lit(1))
    return s.join(found, "symbol_key", "left").groupBy("repo", "kind").agg(F.count("*").alias("n"), F.count("described").alias("n_described"))


QUERIES = {"p3_found": p3_found, "p3_pairs": p3_pairs, "p3_rates": p3_rates}
SQL: dict[str, str] = {}
