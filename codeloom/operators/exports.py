"""The index as JSON, one line per record: metadata, modules, files, symbols and the graph; texts for written summaries.

A record is a line, never a whole repository, so an export of any size is written by many tasks; lines() lays them out
as text files per kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators import catalog as c

#: Version of the layout of the exports.
SCHEMA_VERSION = 1
#: Tokens that a symbol counts for in the index.
SYMBOL_TOKENS = 150


def estimate(size: Column) -> Column:
    """A quarter of the bytes, rounded half up, at least 50."""
    return F.greatest(F.lit(50), F.floor(F.coalesce(size, F.lit(0)) / 4 + 0.5)).cast("long")


def _json(*fields) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def meta(files: DataFrame, symbols: DataFrame, updated_at: str) -> DataFrame:
    """repo and one JSON record with the counts of files, visible modules and symbols and the languages."""
    langs = files.select("repo", F.coalesce("language", F.lit("unknown")).alias("l")).distinct().groupBy("repo").agg(F.sort_array(F.collect_list("l")).alias("languages"))  # at most one entry per language
    m = files.where(~F.col("module").isin(*c.HIDDEN_MODULES)).select("repo", "module").distinct().groupBy("repo").agg(F.count("*").alias("m"))
    n = symbols.groupBy("repo").agg(F.count("*").alias("n"))
    g = files.groupBy("repo").agg(F.count("*").alias("f")).join(langs, "repo").join(m, "repo", "left").join(n, "repo", "left").fillna(0, ["m", "n"])
    record = _json(F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.lit(updated_at).alias("updatedAt"), F.col("f").alias("fileCount"), F.col("m").alias("moduleCount"), F.col("n").alias("symbolCount"), "languages")
    return g.select("repo", record.alias("json"))


def valid(records: DataFrame, version: int = SCHEMA_VERSION) -> DataFrame:
    """repo and whether its metadata has the version of this layout; unreadable records are not valid."""
    return records.select("repo", F.coalesce(F.from_json("json", "schemaVersion int")["schemaVersion"] == version, F.lit(False)).alias("valid"))


def index_lines(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo, kind (modules, files, symbols) and the JSON record of every entry of the index."""
    n = symbols.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(F.col("visibility") == "public").alias("p"))
    m = files.where("module <> '_tests'").groupBy("repo", "module").agg(F.count("*").alias("files"))
    modules = m.select("repo", F.lit("modules").alias("kind"), _json(F.col("module").alias("id"), F.concat(F.lit("modules/"), "module", F.lit(".md")).alias("path"), "files").alias("json"))
    owner = F.when(F.col("module") == "_tests", "_root").otherwise(F.col("module"))
    f = files.join(n, "file_id", "left").fillna(0, ["n", "p"])
    of_files = f.select("repo", F.lit("files").alias("kind"), _json(F.col("repo_path").alias("path"), owner.alias("module"), "language", F.col("n").alias("symbols"), F.col("p").alias("publicSymbols"), estimate(F.col("size")).alias("tokens")).alias("json"))
    of_symbols = symbols.select("repo", F.lit("symbols").alias("kind"), _json("id", "name", "kind", "file", F.col("line_start").alias("line"), "visibility", F.lit(SYMBOL_TOKENS).alias("tokens")).alias("json"))
    return modules.unionByName(of_files).unionByName(of_symbols)


def graph_lines(edges: DataFrame) -> DataFrame:
    """repo, kind (imports, dependents) and the JSON record of every edge and of every distinct reverse link."""
    imports = edges.select("repo", F.lit("imports").alias("kind"), _json(F.col("from_path").alias("from"), F.col("to_path").alias("to"), F.col("edge_ord").alias("ord")).alias("json"))
    links = edges.select("repo", "to_path", "from_path").distinct()
    return imports.unionByName(links.select("repo", F.lit("dependents").alias("kind"), _json(F.col("to_path").alias("path"), F.col("from_path").alias("importer")).alias("json")))


def write_lines(records: DataFrame, folder: str) -> None:
    """JSON lines in one folder per kind; a rewrite replaces all of them when it commits."""
    records.select("kind", "json").write.mode("overwrite").partitionBy("kind").text(folder)


def prompt_symbols(files: DataFrame, symbols: DataFrame, shown: int = 30) -> DataFrame:
    """file_id and its first symbols, one a line with signature and docstring.

    Each salt ranks its own share first, so that a file with a third of all symbols is no single sort.
    """
    s = symbols.join(files.select("file_id"), "file_id", "left_semi")
    line = F.concat(F.lit("["), F.coalesce("kind", F.lit("")), F.lit("] "), F.coalesce("signature", F.lit("")), F.when(F.col("docstring") != "", F.concat(F.lit(" — "), "docstring")).otherwise(""))
    return _first_lines(s, ["file_id"], ["symbol_ord", "symbol_key"], "symbol_key", line, shown, "symbols")


def prompt_files(files: DataFrame, shown: int = 12) -> DataFrame:
    """repo, module and its first files, one a line with their summaries."""
    line = F.concat("repo_path", F.when(F.col("summary") != "", F.concat(F.lit(": "), "summary")).otherwise(""))
    return _first_lines(files, ["repo", "module"], ["file_ord", "repo_path", "file_id"], "file_id", line, shown, "files")


def _first_lines(df: DataFrame, keys: list[str], order: list[str], salt: str, line: Column, shown: int, name: str) -> DataFrame:
    rows = df.select(*keys, *[F.col(x).alias(f"o{i}") for i, x in enumerate(order)], F.pmod(F.xxhash64(salt), F.lit(32)).alias("salt"), line.alias("t"))
    o = [f"o{i}" for i in range(len(order))]
    own = rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(*o))).where(F.col("k") <= shown)
    top = own.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*o))).where(F.col("k") <= shown)
    return top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "\n").alias(name))
