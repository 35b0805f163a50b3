"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.leakage import leaks
from codeloom.session import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents repeat each evaluation item, items that did not leak included."""
    items = table(spark, sf_dir, "eval_items")
    found = p7_found(spark, sf_dir)
    return items.select("item_id", "suite").join(found, "item_id", "left").groupBy("item_id", "suite").agg(F.count("doc_id").alias("n_docs"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
SQL: dict[str, str] = {}
