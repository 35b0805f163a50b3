"""Folders of source files as a DataFrame: the listing of a shared file system under its ignore rules.

Spark's own file sources leave out names that begin with _ or ., which are source files too (__init__.py). This source
lists the first levels where the plan is made, without reading any file, and each task walks the folders of one share.
Listings are rows of names and sizes; texts are read by with_text, in the tasks.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeloom.functions.globs import DEFAULT_IGNORES, is_ignored, rules
from codeloom.langs import language

SCHEMA = "abs_path string, repo_path string, size long, mtime_ms double"
#: Folder levels below the root that the listing splits into shares.
LEVELS = 2


class _Share(InputPartition):
    def __init__(self, folders: list[str], files: list[str]):
        self.folders, self.files = folders, files


def _compiled(lines: list[str]) -> list[tuple[re.Pattern, bool]]:
    return [(re.compile(r), i) for r, i in rules(lines)]


def _entries(root: str, folder: str, found) -> tuple[list[str], list[str]]:
    """Paths of the folders and files of a folder that are kept, in order; hidden names and links to folders are not."""
    folders, files = [], []
    with os.scandir(os.path.join(root, folder)) as it:
        for e in sorted(it, key=lambda e: e.name):
            path = f"{folder}/{e.name}" if folder else e.name
            if e.name.startswith("."):
                continue
            if e.is_dir(follow_symlinks=False):
                if not is_ignored(path + "/x", found):
                    folders.append(path)
            elif e.is_file() and not is_ignored(path, found):
                files.append(path)
    return folders, files


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.shares = int(options.get("shares", "64"))
        lines = [x for x in options.get("ignores", "").split("\n") if x]
        own = os.path.join(self.root, ".gitignore")
        if os.path.isfile(own):
            with open(own, encoding="utf-8", errors="replace") as f:
                lines += f.read().splitlines()
        self.lines = lines

    def partitions(self):
        found = _compiled(self.lines)
        folders, files = [""], []
        for _ in range(LEVELS):
            below = []
            for folder in folders:
                more, here = _entries(self.root, folder, found)
                below += more
                files += here
            folders = below
        n = max(1, min(self.shares, len(folders) + len(files)))
        return [_Share(folders[i::n], files[i::n]) for i in range(n)]

    def read(self, partition) -> Iterator[tuple]:
        found = _compiled(self.lines)
        folders, files = list(partition.folders), list(partition.files)
        while files or folders:
            for path in files:
                at = os.path.join(self.root, path)
                try:
                    stat = os.stat(at)
                except OSError:
                    continue  # gone since it was listed
                yield at, path, stat.st_size, stat.st_mtime * 1000.0
            files = []
            if folders:
                more, files = _entries(self.root, folders.pop(), found)
                folders += more


class SourceTree(DataSource):
    """Format "source_tree"; options path, ignores (patterns, one a line) and shares (most tasks)."""

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def walk(spark: SparkSession, root: str, ignores: tuple[str, ...] = DEFAULT_IGNORES, max_files: int = 0) -> DataFrame:
    """abs_path, repo_path, size, mtime_ms, language of the files under root that no rule ignores.

    Rules are the given patterns, then those of the root's .gitignore; of those that match, the last counts. max_files is
    a feature: the first files by path, 0 for all. An empty folder gives no rows.
    """
    spark.dataSource.register(SourceTree)
    df = spark.read.format("source_tree").option("path", root).option("ignores", "\n".join((".git", *ignores))).load()
    df = df.withColumn("language", language(F.col("repo_path")))
    return df.orderBy("repo_path").limit(max_files) if max_files > 0 else df


def with_text(files: DataFrame) -> DataFrame:
    """files with their text and its hash, read in the tasks; files that are gone have null for both."""

    def run(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 64):
                part = pdf.iloc[a : a + 64]
                texts = []
                for at in part["abs_path"]:
                    try:
                        with open(at, encoding="utf-8", errors="replace", newline="") as f:
                            texts.append(f.read())
                    except OSError:
                        texts.append(None)
                yield part.assign(text=pd.Series(texts, index=part.index, dtype=object))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInPandas(run, f"{fields}, text string").withColumn("content_hash", F.sha2("text", 256))
