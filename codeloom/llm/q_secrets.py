"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.secrets import located, masked_documents, masked_symbols
from codeloom.session import cut, table


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(table(spark, sf_dir, "documents"), table(spark, sf_dir, "symbols"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir).select("tbl", "row_key", "field", "line_no").distinct()


def p5_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, row_key, field, text and n_masked: all documents, signatures and docstrings with their credentials masked."""
    found = cut(_located(spark, sf_dir))
    d = masked_documents(table(spark, sf_dir, "documents"), found).select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_key"), F.lit("text").alias("field"), "text", "n_masked")
    return d.unionByName(masked_symbols(table(spark, sf_dir, "symbols"), found).withColumn("tbl", F.lit("symbols")))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_found(spark, sf_dir).groupBy("tbl", "field").agg(F.count("*").alias("n_lines"), F.countDistinct("row_key").alias("n_rows"))


QUERIES = {"p5_found": p5_found, "p5_masked": p5_masked, "p5_rates": p5_rates}
SQL: dict[str, str] = {}
