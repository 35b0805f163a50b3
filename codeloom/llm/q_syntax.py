"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.syntax import checked
from codeloom.session import table


def p2_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that do not parse, with the line of the furthest position reached and the cause."""
    return checked(table(spark, sf_dir, "files"), table(spark, sf_dir, "documents")).where("cause IS NOT NULL")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_failures(spark, sf_dir).select("file_id")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, failures and indexed symbols per repository and language."""
    files = checked(table(spark, sf_dir, "files"), table(spark, sf_dir, "documents"))
    n = table(spark, sf_dir, "symbols").select("file_id", "symbol_key").distinct().groupBy("file_id").agg(F.count("*").alias("n"))
    return files.join(n, "file_id", "left").groupBy("repo", "language").agg(F.count("*").alias("n_files"), F.count("cause").alias("n_bad"), F.sum(F.coalesce("n", F.lit(0))).alias("n_symbols"))


QUERIES = {"p2_found": p2_found, "p2_failures": p2_failures, "p2_rates": p2_rates}
SQL: dict[str, str] = {}
