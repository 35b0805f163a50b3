"""The index as DataFrames: files, symbols and import edges without repeated deliveries, and what is derived from them.

Every operator is a plan over these three; only keys and needed columns go through a shuffle, all aggregations combine
on the map side, and no side is broadcast by hint. Keys that are null are no rows of the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.tokens import VOCABULARY, n_tokens

FILE = ["ingested_at", "repo", "repo_path", "language", "size", "mtime_ms", "content_hash", "summary", "file_ord"]
SYMBOL = ["ingested_at", "repo", "file_id", "id", "name", "kind", "file", "signature", "line_start", "line_end", "docstring", "parent_id", "visibility", "complexity", "symbol_ord"]
EDGE = ["ingested_at", "repo", "from_path", "to_path", "is_relative", "edge_ord"]

# Paths of test files.
TEST_PATHS = (
    r"(^|/)__tests__/",
    r"\.test\.[a-z]+$",
    r"\.spec\.[a-z]+$",
    r"(^|/)test_(.+)\.[a-z]+$",
    r"(^|/)(.+)_test\.[a-z]+$",
    r"(^|/)spec/",
)
# Modules that pages do not show.
HIDDEN_MODULES = ("_tests", "_root")


def first_delivery(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key: the earliest delivery, ties by the other columns in order, nulls first."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("r")).select(key, "r.*")


def live_files(files: DataFrame, aliases: tuple[tuple[str, str], ...] = (), skip: tuple[str, ...] = (".git/",)) -> DataFrame:
    """Files that no delivery marks as removed, outside the folders skip, with their module."""
    gone = F.max("deleted_at").alias("gone")
    rows = files.where("file_id IS NOT NULL")
    for folder in skip:
        rows = rows.where(~F.coalesce(F.startswith("repo_path", F.lit(folder)), F.lit(False)))
    df = rows.groupBy("file_id").agg(F.min(F.struct(*FILE)).alias("r"), gone)
    return df.where("gone IS NULL").select("file_id", "r.*", module(F.col("r.repo_path"), aliases).alias("module"))


def symbols_once(symbols: DataFrame) -> DataFrame:
    return first_delivery(symbols, "symbol_key", SYMBOL)


def edges_once(imports: DataFrame) -> DataFrame:
    """Import edges with both ends; repeated (repo, from, to) stay apart by their key."""
    return first_delivery(imports, "edge_key", EDGE).where("from_path <> '' AND to_path <> ''")


def is_test(path: Column) -> Column:
    found = [path.rlike(p) for p in TEST_PATHS]
    return found[0] | found[1] | found[2] | found[3] | found[4] | found[5]


def module(path: Column, aliases: tuple[tuple[str, str], ...] = ()) -> Column:
    """_tests for test files; else the first segment of the name of the first alias (folder, name) whose folder is the
    path or above it; else the first segment of the path, which is the file itself at the root; _root where that is empty."""
    out = F.when(is_test(path), "_tests")
    for folder, name in aliases:
        out = out.when((path == folder) | F.startswith(path, F.lit(f"{folder}/")), name.split("/")[0] or "_root")
    first = F.substring_index(path, "/", 1)
    return out.when(first == "", "_root").otherwise(first)


def top_level_dir(path: Column) -> Column:
    """The first folder of a path, _root for files at the root."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("_root")


def dependents(edges: DataFrame) -> DataFrame:
    """repo, path, importer and the place (edge_ord, edge_key) where it first appears: one row per link, so that a path
    that a third of all files import stays many rows."""
    pair = edges.groupBy("repo", F.col("to_path").alias("path"), F.col("from_path").alias("importer")).agg(F.min(F.struct("edge_ord", "edge_key")).alias("o"))
    return pair.select("repo", "path", "importer", "o.edge_ord", "o.edge_key")


def dependent_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("repo", "path").agg(F.count("*").alias("n_dependents"))


def module_edges(edges: DataFrame) -> DataFrame:
    """Edges between modules of a repository with their weights; edges inside a module do not count."""
    m = edges.select("repo", module(F.col("from_path")).alias("from_module"), module(F.col("to_path")).alias("to_module"))
    return m.where("from_module <> to_module").groupBy("repo", "from_module", "to_module").agg(F.count("*").alias("weight"))


def visible_modules(files: DataFrame) -> DataFrame:
    """repo, module, n_files, place (1, 2, ... by name within the repository) of every module that pages show."""
    m = files.where(~F.col("module").isin(*HIDDEN_MODULES)).groupBy("repo", "module").agg(F.count("*").alias("n_files"))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy("module")))


def visible_edges(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges between two different modules, both of them in modules: weight and first appearance.

    Edges shrink to one row per pair of modules before they meet the modules.
    """
    m = edges.select("repo", module(F.col("from_path")).alias("from_module"), module(F.col("to_path")).alias("to_module"), F.struct("edge_ord", "edge_key").alias("o"))
    m = m.where("from_module <> to_module").groupBy("repo", "from_module", "to_module").agg(F.count("*").alias("weight"), F.min("o").alias("first"))
    for side in ("from_module", "to_module"):
        m = m.join(modules.select("repo", F.col("module").alias(side)), ["repo", side], "left_semi")
    return m.select("repo", "from_module", "to_module", "weight", "first")


def shown_edges(edges: DataFrame, files: DataFrame, most: int = 30) -> DataFrame:
    """The first edges, in order of appearance, between the first visible modules of each repository: at most most of
    both, which is what a diagram holds. place is the edge's ordinal."""
    shown = visible_modules(files).where(F.col("place") <= most)
    w = Window.partitionBy("repo").orderBy("first", "from_module", "to_module")
    ranked = visible_edges(edges, shown).withColumn("place", F.row_number().over(w))
    return ranked.where(F.col("place") <= most).select("repo", "place", "from_module", "to_module", "weight")


def diagram_nodes(edges: DataFrame) -> DataFrame:
    """Neighbours of every module in order of first appearance: repo, module, direction (in, out), place from 0, other.

    Links are one row per pair of modules before they are ranked; the module itself is left out and takes no ordinal.
    """
    m = edges.select("repo", module(F.col("from_path")).alias("a"), module(F.col("to_path")).alias("b"), F.struct("edge_ord", "edge_key").alias("o"))
    m = m.where("a <> b").groupBy("repo", "a", "b").agg(F.min("o").alias("first"))
    out = m.select("repo", F.col("a").alias("module"), F.lit("out").alias("direction"), F.col("b").alias("other"), "first")
    both = out.unionByName(m.select("repo", F.col("b").alias("module"), F.lit("in").alias("direction"), F.col("a").alias("other"), "first"))
    w = Window.partitionBy("repo", "module", "direction").orderBy("first", "other")
    return both.select("repo", "module", "direction", (F.row_number().over(w) - 1).alias("place"), "other")


def diagram_id(name: Column) -> Column:
    """A name for a node of a diagram: all but letters and digits become _, a digit in front gets one before it."""
    return F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9]", "_"), "^([0-9])", "_$1")


def degrees(edges: DataFrame, side: str) -> DataFrame:
    """Distinct modules on the other side, per repo and module; side is 'out' or 'in'; the module itself counts."""
    a, b = ("from_path", "to_path") if side == "out" else ("to_path", "from_path")
    pairs = edges.select("repo", module(F.col(a)).alias("module"), module(F.col(b)).alias("other")).distinct()
    return pairs.groupBy("repo", "module").agg(F.count("*").alias(f"{side}_degree"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Each file with its distinct callers and callees, one row per direction and other file."""
    up = edges.select("repo", F.col("to_path").alias("path"), F.lit("caller").alias("direction"), F.col("from_path").alias("other"))
    down = edges.select("repo", F.col("from_path").alias("path"), F.lit("callee").alias("direction"), F.col("to_path").alias("other"))
    return up.unionByName(down).distinct()


def entries(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Modules but for the tests, files and symbols as one list: repo, band (0, 1, 2), kind, id, name, file, module."""
    none = F.lit(None).cast("string")
    m = files.where("module <> '_tests'").select("repo", F.lit(0).alias("band"), F.lit("module").alias("kind"), F.col("module").alias("id"), F.col("module").alias("name"), none.alias("file"), "module").distinct()
    f = files.select("repo", F.lit(1).alias("band"), F.lit("file").alias("kind"), F.col("repo_path").alias("id"), F.col("repo_path").alias("name"), F.col("repo_path").alias("file"), F.when(F.col("module") == "_tests", "_root").otherwise(F.col("module")).alias("module"))
    s = symbols.select("repo", F.lit(2).alias("band"), "kind", "id", "name", "file", none.alias("module"))
    return m.unionByName(f).unionByName(s)


_ORDER = ["band", "repo", "id", "kind", "name", "file", "module"]


def search(catalog: DataFrame, text: str, limit: int = 20, kind: str | None = None) -> DataFrame:
    """The first entries whose name holds text, case and outer white space ignored: modules, files, then symbols; only
    one of these kinds if given. limit is the feature; a blank text has no hits."""
    wanted = text.strip().lower()
    hits = catalog.where(F.contains(F.lower("name"), F.lit(wanted)) & F.lit(wanted != ""))
    if kind is not None:
        hits = hits.where(F.col("band") == {"module": 0, "file": 1, "symbol": 2}[kind])
    return hits.orderBy(*_ORDER).limit(limit)


def cursor(resource: Column) -> Column:
    """Offset in a resource such as tree?cursor=50; 0 where there is none."""
    return F.coalesce(F.regexp_extract(resource, r"[?&]cursor=(\d+)", 1).try_cast("bigint"), F.lit(0))


def page(catalog: DataFrame, number: int, size: int = 50) -> DataFrame:
    """One page of all entries in order."""
    return catalog.orderBy(*_ORDER).offset(number * size).limit(size)


def last_per_page(symbols: DataFrame) -> DataFrame:
    """Symbols of equal id share a page: the last in order of the index wins."""
    return symbols.groupBy("repo", "id").agg(F.max(F.struct("symbol_ord", "symbol_key")).alias("w"), F.count("*").alias("n_written")).select("repo", "id", F.col("w.symbol_key").alias("symbol_key"), "n_written")


def public_surface(symbols: DataFrame, files: DataFrame, shown: int = 3, between: str = ", ") -> DataFrame:
    """First public symbols of each module as text, and how many more there are.

    The rank comes from a window only over symbols that could be shown: first each file's own first ones.
    """
    public = symbols.where("visibility = 'public'").join(files.select("file_id", "module", "file_ord"), "file_id")
    total = public.groupBy("repo", "module").agg(F.count("*").alias("n_public"))
    order = ["file_ord", "symbol_ord", "symbol_key"]
    own = public.withColumn("k", F.row_number().over(Window.partitionBy("file_id").orderBy("symbol_ord", "symbol_key"))).where(F.col("k") <= shown)
    top = own.withColumn("k", F.row_number().over(Window.partitionBy("repo", "module").orderBy(*order))).where(F.col("k") <= shown)
    text = top.groupBy("repo", "module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(" ", "kind", "name").alias("t")))), lambda x: x["t"]), between).alias("surface"))
    return total.join(text, ["repo", "module"]).withColumn("n_more", F.greatest(F.col("n_public") - shown, F.lit(0)))


def documentation(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, n_symbols, documented (any symbol has a docstring that is not empty) and most_complex of every file that
    has a language and symbols."""
    documented = F.max(F.coalesce(F.col("docstring") != "", F.lit(False)))
    g = symbols.groupBy("file_id").agg(F.count("*").alias("n_symbols"), documented.alias("documented"), F.max(F.coalesce("complexity", F.lit(0))).alias("most_complex"))
    return g.join(files.where("language <> ''").select("file_id"), "file_id", "left_semi")


def signature_tokens(symbols: DataFrame, files: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """file_id and the tokens of a file's summary and signatures, one a line.

    White space around a line break never joins tokens of two lines that begin with other characters, so lines are
    counted where they are and summed: no file is gathered in one task.
    """
    s = symbols.select("file_id", F.struct("symbol_ord", "symbol_key").alias("o"), F.coalesce("signature", F.lit("")).alias("t"))
    f = files.select("file_id", F.lit(None).cast(s.schema["o"].dataType).alias("o"), F.coalesce("summary", F.lit("")).alias("t"))
    lines = s.unionByName(f).select("file_id", "o", n_tokens(F.concat("t", F.lit("\n")), path).alias("n"), n_tokens(F.col("t"), path).alias("bare"))
    # the line break behind the last line does not count
    g = lines.groupBy("file_id").agg(F.sum("n").alias("n"), F.max(F.struct(F.col("o").isNotNull().alias("is"), "o", (F.col("n") - F.col("bare")).alias("over"))).alias("last"))
    return g.select("file_id", (F.col("n") - F.col("last.over")).alias("n_tokens"))


def worth_summary(symbols: DataFrame, files: DataFrame, path: str = VOCABULARY, complex_over: int = 15, tokens_over: int = 800) -> DataFrame:
    """Files with a language and symbols of which none is documented, one is complex, or which say much: candidates for a
    written summary."""
    g = documentation(symbols, files).join(signature_tokens(symbols, files, path), "file_id")
    return g.where((~F.col("documented")) | (F.col("most_complex") > complex_over) | (F.col("n_tokens") > tokens_over)).select("file_id", "n_symbols", "most_complex", "n_tokens")


def summary_key(content_hash: Column) -> Column:
    """Key of a file's written summary in the cache."""
    return F.sha2(F.concat(content_hash, F.lit("|enrich-file")), 256)


def short_hash(text: Column, length: int = 12) -> Column:
    return F.left(F.sha2(text, 256), F.lit(length))


def cache_miss(files: DataFrame, cache: DataFrame) -> DataFrame:
    """file_id and key of files whose summary is not in the cache (column key)."""
    return files.select("file_id", summary_key(F.col("content_hash")).alias("key")).where("key IS NOT NULL").join(cache.select("key").distinct(), "key", "left_anti").select("file_id", "key")


def static_summary(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_id and a line that says how long a source text is, how many symbols it has and how its code begins.

    texts has file_id, repo_path and text; null texts count as empty. Symbols meet the texts as counts only.
    """
    n = symbols.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(F.col("visibility") == "public").alias("p"))
    lines = F.split(F.coalesce("text", F.lit("")), "\r?\n", -1)
    trimmed = F.transform(lines, lambda x: F.regexp_replace(x, r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", ""))
    code = F.get(F.filter(trimmed, lambda x: (x != "") & ~x.rlike(r"^(//|#|/\*|\*)")), 0)
    line = texts.select("file_id", F.element_at(F.split("repo_path", "/"), -1).alias("name"), F.size(lines).alias("lines"), F.left(code, F.lit(80)).alias("begins"))
    parts = [
        F.concat(F.col("lines").cast("string"), F.lit(" lines")),
        F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" symbols ("), F.col("p").cast("string"), F.lit(" public)"))),
        F.when(F.col("begins").isNotNull(), F.concat(F.lit("starts: `"), "begins", F.lit("`"))),
    ]
    return line.join(n, "file_id", "left").select("file_id", F.concat("name", F.lit(": "), F.concat_ws(", ", *parts), F.lit(".")).alias("summary"))


def summary_json(text: Column) -> tuple[Column, Column]:
    """(purpose, notes) of a written answer: of the first {...} with both as strings, else the first line and the rest."""
    inner = F.from_json(F.regexp_extract(text, r"\{[\s\S]*?\}", 0), "purpose string, notes string")
    good = inner["purpose"].isNotNull() & inner["notes"].isNotNull()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x != "")
    first = F.left(F.coalesce(F.get(lines, 0), F.lit("")), F.lit(200))
    rest = F.left(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), " "), F.lit(400))
    return F.when(good, inner["purpose"]).otherwise(first), F.when(good, inner["notes"]).otherwise(rest)


def member_hash(files: DataFrame) -> DataFrame:
    """Hash of the sorted content hashes of each module, for those who compare with written ones: a module is one list
    here. member_digest says the same and stays small for any module."""
    joined = F.array_join(F.sort_array(F.collect_list(F.coalesce("content_hash", F.lit("")))), "|")
    return files.groupBy("repo", "module").agg(F.sha2(F.concat(joined, F.lit("|enrich-module")), 256).alias("hash"), F.count("*").alias("n_files"))


def member_digest(files: DataFrame) -> DataFrame:
    """Digest of the content hashes of each module that no order of files changes: a sum of 60 bits of each."""
    bits = F.conv(F.left(F.sha2(F.coalesce("content_hash", F.lit("")), 256), F.lit(15)), 16, 10).cast("decimal(38,0)")
    g = files.groupBy("repo", "module").agg(F.sum(bits).alias("s"), F.count("*").alias("n_files"))
    return g.select("repo", "module", F.sha2(F.concat_ws("|", F.col("s").cast("string"), F.col("n_files").cast("string"), F.lit("enrich-module")), 256).alias("digest"), "n_files")


def state_diff(files: DataFrame, state: DataFrame) -> DataFrame:
    """added, removed, changed or same for every path of the index or of its last build, in one full outer join."""
    now = files.select("repo", "repo_path", "content_hash")
    then = state.select("repo", "repo_path", "hash").distinct().withColumn("was", F.lit(True))
    j = now.withColumn("is", F.lit(True)).join(then, ["repo", "repo_path"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("content_hash").eqNullSafe(F.col("hash")), "same").otherwise("changed")
    return j.select("repo", "repo_path", change.alias("change"))


def changed_since(diff: DataFrame, shown: int = 20) -> DataFrame:
    """Per repository: n_changed, and the first shown changed paths by name as text; same files do not count.

    Each salt ranks its own share first, so that a repository with a third of all changes is no single sort.
    """
    changed = diff.where("change <> 'same'").withColumn("salt", F.pmod(F.xxhash64("repo_path"), F.lit(32)))
    own = changed.withColumn("k", F.row_number().over(Window.partitionBy("repo", "salt").orderBy("repo_path"))).where(F.col("k") <= shown)
    top = own.withColumn("k", F.row_number().over(Window.partitionBy("repo").orderBy("repo_path", "salt"))).where(F.col("k") <= shown)
    text = top.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_list("repo_path")), ", ").alias("first_changed"))
    return changed.groupBy("repo").agg(F.count("*").alias("n_changed")).join(text, "repo")


def stale_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files modified after the last build of their repository; those of repositories without a build are not stale.

    The builds are one row per repository after their aggregation.
    """
    built = state.groupBy("repo").agg(F.unix_millis(F.max("last_indexed_at")).alias("built"))
    return files.join(built, "repo").where(F.col("mtime_ms") > F.col("built")).select("repo", "repo_path")


def stale_counts(files: DataFrame, state: DataFrame) -> DataFrame:
    """Per repository with a build: n_files, n_stale, and by how many milliseconds the newest file is later than the build."""
    built = state.groupBy("repo").agg(F.unix_millis(F.max("last_indexed_at")).alias("built"))
    late = F.col("mtime_ms").cast("long") - F.col("built")
    return files.join(built, "repo").groupBy("repo").agg(F.count("*").alias("n_files"), F.count_if(F.col("mtime_ms") > F.col("built")).alias("n_stale"), F.max(late).alias("latest_ms"))


def file_changes(files: DataFrame, since: Column) -> DataFrame:
    """Files whose time of change is after a moment, with their repository: the scan that needs no state."""
    return files.where(F.col("mtime_ms") > F.unix_millis(since)).select("repo", "repo_path", "mtime_ms")


def page_lookup(wanted: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each wanted (repo, id) the page that answers: that of the file, else of the module, else of the symbol of that
    id; path is null where there is none. Repeated ids count once; nulls give no row."""
    w = wanted.where("repo IS NOT NULL AND id IS NOT NULL").select("repo", "id").distinct()
    pages = files.select("repo", F.col("repo_path").alias("id"), F.lit(0).alias("rank")).unionByName(files.select("repo", F.col("module").alias("id"), F.lit(1).alias("rank")).where(~F.col("id").isin(*HIDDEN_MODULES))).unionByName(symbols.select("repo", "id", F.lit(2).alias("rank")))
    best = pages.groupBy("repo", "id").agg(F.min("rank").alias("rank"))
    path = F.when(F.col("rank") == 0, F.concat(F.lit("files/"), "id", F.lit(".md"))).when(F.col("rank") == 1, F.concat(F.lit("modules/"), "id", F.lit(".md"))).when(F.col("rank") == 2, F.concat(F.lit("symbols/"), F.regexp_replace("id", "^(.*?)::", "$1/"), F.lit(".md")))
    return w.join(best, ["repo", "id"], "left").select("repo", "id", path.alias("path"))


def routed(uri: Column, scheme: str = "wiki") -> Column:
    """Path of the page that a resource address names; null for other addresses. A cursor behind ? is no part of it."""
    base = F.regexp_replace(uri, r"\?.*$", "")
    named = lambda kind: F.regexp_extract(base, rf"^{scheme}://{kind}/(.+)$", 1)
    out = F.when(base.isin(f"{scheme}://tree", f"{scheme}://index"), "INDEX.md").when(base == f"{scheme}://architecture", "architecture.md")
    for kind in ("module", "file", "symbol", "graph"):
        out = out.when(named(kind) != "", F.concat(F.lit("graph/" if kind == "graph" else f"{kind}s/"), named(kind), F.lit(".md")))
    return out


def links_of(wanted: DataFrame, edges: DataFrame, direction: str) -> DataFrame:
    """repo, id, other: for each wanted symbol id the files that import its file ('callers') or that it imports ('callees').

    The file of an id is what stands before ::. Edges shrink to distinct links first.
    """
    a, b = ("to_path", "from_path") if direction == "callers" else ("from_path", "to_path")
    w = wanted.where("repo IS NOT NULL AND id <> ''").select("repo", "id", F.substring_index("id", "::", 1).alias("file")).distinct()
    links = edges.select("repo", F.col(a).alias("file"), F.col(b).alias("other")).distinct()
    return w.join(links, ["repo", "file"]).select("repo", "id", "other")


def sessions(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """Bursts of events of one key that are less than gap apart: start and number of events (batch or stream)."""
    return events.where(F.col(time).isNotNull()).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n_events")).select(key, F.col("w.start").alias("started_at"), "n_events")
