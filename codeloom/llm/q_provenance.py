"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.provenance import judged
from codeloom.session import table


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source file with the reason why it is not hand-written, null where it is."""
    return judged(table(spark, sf_dir, "files"), table(spark, sf_dir, "documents"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_reasons(spark, sf_dir).where("reason IS NOT NULL").select("file_id")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_reasons(spark, sf_dir).groupBy("repo").agg(F.count("*").alias("n_files"), F.count("reason").alias("n_not_by_hand"))


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p1_reasons": p1_reasons}
SQL: dict[str, str] = {}
