"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.abuse import scored, train
from codeloom.session import table


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text."""
    documents = table(spark, sf_dir, "documents")
    return scored(documents, train(documents, table(spark, sf_dir, "doc_labels")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).where("score > 0").select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and abusive texts per source."""
    both = table(spark, sf_dir, "documents").select("doc_id", "source").join(p8_found(spark, sf_dir).withColumn("bad", F.lit(1)), "doc_id", "left")
    return both.groupBy("source").agg(F.count("*").alias("n_docs"), F.count("bad").alias("n_abusive"))


QUERIES = {"p8_found": p8_found, "p8_rates": p8_rates, "p8_scores": p8_scores}
SQL: dict[str, str] = {}
