"""Session helpers: checkpoint folder, table access, size checks."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Most bytes of a side that may be broadcast by a hint of this library.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir, or the one the context already has.

    Only a local master, whose tasks share the driver's disk, gets a temporary folder where none is named; a cluster
    without one is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if not current:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not current:
        if not re.fullmatch(r"local(\[[^,\]]*(,\s*\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, so that its lineage is not run again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its rows, of at most row_bytes each, are within BROADCAST_BYTES; else as it is.

    df is counted, so it should be written (cut) or cheap.
    """
    from pyspark.sql import functions as F

    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as there are cores: tables of few small files are dealt out before costly work on
    their rows; all others are worked on where they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
