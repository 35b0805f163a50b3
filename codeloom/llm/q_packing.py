"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import packing
from codeloom.session import table


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused share per capacity."""
    specs = table(spark, sf_dir, "pack_specs").select("spec_id", "capacity")
    n = p6_packing(spark, sf_dir).groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n_tokens"))
    n = n.groupBy("spec_id").agg(F.count("*").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("fullest"))
    unused = 1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))
    return n.join(F.broadcast(specs), "spec_id").withColumn("unused", unused)


def p6_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.buckets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"))


QUERIES = {"p6_packing": p6_packing, "p6_fill": p6_fill, "p6_buckets": p6_buckets}
SQL: dict[str, str] = {}
