"""Change events of files as a stream: bursts, invalidation state, events next to the index.

All functions take a batch or a stream. State is bounded by the watermark (bursts) or by the number of paths
(invalidation, kept in a table of the shared folder, not in the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def bursts(changes: DataFrame, key: str, time: str, quiet: str, late: str) -> DataFrame:
    """One row per key and burst, ended when no change came for the time quiet: started_at, n_changes, paths (distinct).

    changes has the columns key, time and path; rows without time are dropped, events later than late are not waited for.
    """
    rows = changes.where(F.col(time).isNotNull()).select(key, time, "path").withWatermark(time, late)
    g = rows.groupBy(key, F.session_window(time, quiet).alias("w")).agg(F.count("*").alias("n_changes"), F.sort_array(F.collect_set("path")).alias("paths"))
    return g.select(key, F.col("w.start").alias("started_at"), "n_changes", "paths")


def settled(changes: DataFrame, time: str, quiet: str, late: str = "0 seconds") -> DataFrame:
    """path, settled_at, n_changes, size: one row per path and run of changes, when its size has not changed for quiet.

    changes has path, size and the time column, in a batch or a stream; rows without path or time are dropped. The size is
    that of the last change.
    """
    rows = changes.where(F.col(time).isNotNull() & F.col("path").isNotNull()).select("path", "size", F.col(time).alias("t")).withWatermark("t", late)
    g = rows.groupBy("path", F.session_window("t", quiet).alias("w")).agg(F.count("*").alias("n_changes"), F.max(F.struct("t", "size")).alias("last"))
    return g.select("path", F.col("w.end").alias("settled_at"), "n_changes", F.col("last.size").alias("size"))


def invalidated(state: DataFrame, paths: DataFrame) -> DataFrame:
    """state with public_signature_changed set for every (repo, repo_path) of paths; unknown paths get a row of nulls.

    Repeated paths count once; a row of paths with a null repo or path changes nothing.
    """
    marked = paths.where("repo IS NOT NULL AND repo_path IS NOT NULL").select("repo", "repo_path").distinct().withColumn("hit", F.lit(True))
    other = [c for c in state.columns if c not in ("repo", "repo_path", "public_signature_changed")]
    flag = F.when(F.col("hit"), F.lit(True)).otherwise(F.col("public_signature_changed")).alias("public_signature_changed")
    return state.join(marked, ["repo", "repo_path"], "full").select("repo", "repo_path", *other, flag)


def keep_invalidated(changes: DataFrame, folder: str, checkpoint: str, **options) -> StreamingQuery:
    """Writes the state of every micro-batch under folder/version=<batch>; a batch that runs again writes its own again.

    folder/version=-1 is the state before the stream. Readers take the highest version that has a _SUCCESS file.
    """

    def merge(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.parquet(f"{folder}/version={number - 1}")
        invalidated(before, batch).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(**options)


def annotated(events: DataFrame, files: DataFrame, default_tokens: int = 600) -> DataFrame:
    """events (repo, repo_path, ...) with file_id and tokens of the index; default_tokens where a path is not in it.

    files is static; a third of all events on one path meets a single row of it, which the join splits when skewed.
    """
    known = files.select("repo", "repo_path", "file_id", F.greatest(F.lit(50), F.floor(F.coalesce("size", F.lit(0)) / 4 + 0.5)).cast("long").alias("tokens"))
    return events.join(known, ["repo", "repo_path"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(default_tokens).cast("long")))


def with_page(events: DataFrame, files: DataFrame) -> DataFrame:
    """events (repo, repo_path, ...) with has_page: whether the index has a page of that file."""
    pages = files.select("repo", "repo_path").distinct().withColumn("has_page", F.lit(True))
    return events.join(pages, ["repo", "repo_path"], "left").withColumn("has_page", F.coalesce("has_page", F.lit(False)))
