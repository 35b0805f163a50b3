"""Markdown pages of the index as plan expressions: symbols, files, modules, the architecture and the index of a repository.

A page is a row per part: part 0 is its head, further parts hold PART_ROWS rows each of its long tables, cut by the
order numbers of the index, so that neither a file with very many symbols nor a module with very many files is one row
or one sort. The parts in order are the whole page; whole() joins those of pages with few parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.tokens import VOCABULARY, n_tokens
from codeloom.operators import catalog as c

#: Rows of a table in one part of a page.
PART_ROWS = 500
#: Most parts of a page that whole() joins into one row.
WHOLE_PARTS = 64

# Fence languages by extension of a file.
FENCE = {"ts": "ts", "tsx": "tsx", "js": "js", "py": "python", "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "c": "c", "cpp": "cpp"}


def yaml_string(x: Column) -> Column:
    r"""A quoted YAML string; \, " and line breaks are escaped; null becomes null."""
    escaped = F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def cell(x: Column, most: int) -> Column:
    """Text for a cell of a table: one line, | escaped, at most most characters; null is empty."""
    return F.left(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit(most))


def _text(*parts) -> Column:
    """Parts one after the other: strings, columns, null as nothing."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _parts(df: DataFrame, kind: str, ident: Column, title: Column, folder: str, part: Column, body: Column, language: Column | None = None) -> DataFrame:
    path = F.concat(F.lit(f"{folder}/"), ident, F.lit(".md"))
    return df.select("repo", F.lit(kind).alias("kind"), ident.alias("id"), title.alias("title"), path.alias("path"), part.cast("int").alias("part"), body.alias("body"), (F.lit(None) if language is None else language).cast("string").alias("language"))


def _rows(df: DataFrame, keys: list[str], ordinal: str, order: list[str], line: Column) -> DataFrame:
    """keys, part and the lines of that part in order; lines of null or negative ordinals are in part 1."""
    part = F.greatest(F.floor(F.coalesce(F.col(ordinal), F.lit(0)) / PART_ROWS), F.lit(0)) + 1
    g = df.groupBy(*keys, part.cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("t")))).alias("rows"))
    return g.select(*keys, "part", F.concat(F.array_join(F.transform("rows", lambda x: x["t"]), "\n"), F.lit("\n")).alias("body"))


def symbol_pages(symbols: DataFrame) -> DataFrame:
    """One page per symbol; of symbols with equal repo and id the last in order of the index."""
    shown = ["name", "kind", "file", "signature", "line_start", "line_end", "docstring", "visibility", "complexity"]
    last = symbols.groupBy("repo", "id").agg(F.max(F.struct("symbol_ord", "symbol_key", *shown)).alias("s")).select("repo", "id", "s.*").where("id IS NOT NULL")
    known = F.create_map(*[F.lit(x) for pair in FENCE.items() for x in pair])
    fence = F.coalesce(F.try_element_at(known, F.regexp_extract("file", r"\.([^./]+)$", 1)), F.lit(""))
    body = _text(
        "# ", F.col("name"), "\n\n`", F.col("file"), ":", F.col("line_start"), "-", F.col("line_end"), "`\n\n```", fence, "\n", F.col("signature"), "\n```\n",
        F.when(F.col("docstring") != "", _text("\n", F.col("docstring"), "\n")), "\nvisibility: ", F.coalesce("visibility", F.lit("unknown")), ", complexity: ", F.coalesce("complexity", F.lit(1)), "\n",
    )
    return _parts(last, "symbol", F.regexp_replace("id", "^(.*?)::", "$1/"), F.col("name"), "symbols", F.lit(0), body)


def file_pages(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Language, size, summary and all symbols of every file."""
    n = symbols.groupBy("file_id").agg(F.count("*").alias("n_symbols"))
    heads = files.join(n, "file_id", "left").withColumn("n_symbols", F.coalesce("n_symbols", F.lit(0)))
    head = _text(
        "# File: ", F.col("repo_path"), "\n\n", F.when(F.col("summary") != "", _text("> ", F.col("summary"), "\n")), "\n- **Language**: ", F.coalesce("language", F.lit("unknown")), "\n- **Size**: ", F.col("size"),
        " bytes\n- **Symbols**: ", F.col("n_symbols"), "\n\n",
        F.when(F.col("n_symbols") > 0, "## Symbols\n\n| Name | Kind | Lines | Signature |\n| --- | --- | --- | --- |\n").otherwise("_No symbols extracted (language not yet supported or file is empty)._\n"),
    )
    line = _text("| ", F.col("name"), " | ", F.col("kind"), " | ", F.col("line_start"), "-", F.col("line_end"), " | `", cell(F.col("signature"), 200), "` |")
    rows = _rows(symbols, ["file_id"], "symbol_ord", ["symbol_ord", "symbol_key"], line).join(files.select("file_id", "repo", "repo_path"), "file_id")
    path = F.col("repo_path")
    return _parts(heads, "file", path, path, "files", F.lit(0), head, F.coalesce("language", F.lit("null"))).unionByName(_parts(rows, "file", path, path, "files", F.col("part"), F.col("body")))


def module_pages(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Dependencies, public surface and all files of every module that pages show."""
    f = files.where(~F.col("module").isin(*c.HIDDEN_MODULES))
    n = symbols.groupBy("file_id").agg(F.count("*").alias("n_symbols"), F.count_if(F.col("visibility") == "public").alias("n_public"))
    f = f.join(n, "file_id", "left").withColumns({"n_symbols": F.coalesce("n_symbols", F.lit(0)), "n_public": F.coalesce("n_public", F.lit(0))})
    g = f.groupBy("repo", "module").agg(F.count("*").alias("n_files"), F.sum("n_public").alias("n_public"))
    surface = c.public_surface(symbols, files, 20, "`\n- `").select("repo", "module", "surface", "n_more")
    # the diagram of a module has one node per module that it touches: rows are already distinct modules, not links
    node = F.when(F.col("direction") == "out", _text("  out", F.col("place"), '["', F.col("other"), '"]\n  this --> out', F.col("place"), "\n")).otherwise(_text("  in", F.col("place"), '["', F.col("other"), '"]\n  in', F.col("place"), " --> this\n"))
    nodes = c.diagram_nodes(edges).groupBy("repo", "module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("direction") == "in").alias("d"), "place", node.alias("t")))), lambda x: x["t"]), "").alias("diagram"))
    heads = g.join(surface, ["repo", "module"], "left").join(nodes, ["repo", "module"], "left")
    head = _text(
        "# Module: ", F.col("module"), "\n\n> ", F.col("n_files"), " files, ", F.col("n_public"), " public symbols.\n\n",
        F.when(F.col("diagram").isNotNull(), _text('## Dependencies\n\n```mermaid\ngraph LR\n  this["', F.col("module"), '"]\n', F.col("diagram"), "```\n\n")),
        F.when(F.col("surface").isNotNull(), _text("## Public surface\n\n- `", F.col("surface"), "`\n", F.when(F.col("n_more") > 0, _text("- _(", F.col("n_more"), " more)_\n")), "\n")),
        "## Files\n\n| File | Summary | Symbols |\n| --- | --- | --- |\n",
    )
    line = _text("| [", F.col("repo_path"), "](./files/", F.col("repo_path"), ".md) | ", F.left(F.replace(F.coalesce("summary", F.lit("")), F.lit("|"), F.lit("\\|")), F.lit(120)), " | ", F.col("n_symbols"), " |")
    rows = _rows(f, ["repo", "module"], "file_ord", ["file_ord", "repo_path", "file_id"], line)
    name = F.col("module")
    return _parts(heads, "module", name, name, "modules", F.lit(0), head).unionByName(_parts(rows, "module", name, name, "modules", F.col("part"), F.col("body")))


def _overview(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo, n_files, n_modules (visible), n_symbols of every repository with files."""
    n = symbols.groupBy("repo").agg(F.count("*").alias("n_symbols"))
    m = c.visible_modules(files).groupBy("repo").agg(F.count("*").alias("n_modules"))
    return files.groupBy("repo").agg(F.count("*").alias("n_files")).join(m, "repo", "left").join(n, "repo", "left").fillna(0, ["n_modules", "n_symbols"])


def architecture_pages(files: DataFrame, symbols: DataFrame, edges: DataFrame, most: int = 30) -> DataFrame:
    """The module map, at most most modules and edges, and the table of all visible modules of every repository."""
    modules = c.visible_modules(files)
    shown = modules.where(F.col("place") <= most)
    node = _text("  ", c.diagram_id(F.col("module")), '["', F.col("module"), '"]\n')
    join = lambda df, text: df.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("t")))), lambda x: x["t"]), ""))  # noqa: E731  at most most rows each
    nodes = join(shown, node).toDF("repo", "nodes")
    arrow = _text("  ", c.diagram_id(F.col("from_module")), " -->|", F.col("weight"), F.when(F.col("weight") == 1, " edge").otherwise(" edges"), "| ", c.diagram_id(F.col("to_module")), "\n")
    arrows = join(c.shown_edges(edges, files, most), arrow).toDF("repo", "arrows")
    heads = _overview(files, symbols).join(nodes, "repo", "left").join(arrows, "repo", "left")
    more = F.when(F.col("n_modules") > most, _text('  more["...(', F.col("n_modules") - most, ' more)"]\n'))
    head = _text(
        "# Architecture\n\n> ", F.col("n_files"), " files, ", F.col("n_modules"), " modules, ", F.col("n_symbols"), " symbols.\n\n",
        F.when(F.col("nodes").isNotNull(), _text("## Module map\n\n```mermaid\ngraph LR\n", F.col("nodes"), more, F.col("arrows"), "```\n\n")),
        "## Modules\n\n| Module | Files | Public surface | Imports | Imported by |\n| --- | --- | --- | --- | --- |\n",
    )
    surface = c.public_surface(symbols, files, 3, "`, `").select("repo", "module", "surface")
    table = modules.join(surface, ["repo", "module"], "left").join(c.degrees(edges, "out"), ["repo", "module"], "left").join(c.degrees(edges, "in"), ["repo", "module"], "left").fillna(0, ["out_degree", "in_degree"])
    public = F.coalesce(_text_or_null("`", F.col("surface"), "`..."), F.lit("_Internal-only_"))
    line = _text("| [", F.col("module"), "](./modules/", F.col("module"), ".md) | ", F.col("n_files"), " | ", public, " | ", F.col("out_degree"), " | ", F.col("in_degree"), " |")
    rows = _rows(table, ["repo"], "place", ["place"], line)
    one, title = F.lit("architecture"), F.lit("Architecture")
    out = _parts(heads, "architecture", one, title, "x", F.lit(0), head).unionByName(_parts(rows, "architecture", one, title, "x", F.col("part"), F.col("body")))
    return out.withColumn("path", F.lit("architecture.md"))


def _text_or_null(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def index_pages(files: DataFrame, symbols: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """All visible modules of every repository with their sizes, and its recently changed paths (repo, first_changed)."""
    heads = _overview(files, symbols)
    heads = heads.join(changed.select("repo", "first_changed"), "repo", "left") if changed is not None else heads.withColumn("first_changed", F.lit(None).cast("string"))
    head = _text(
        "# Code Index\n\n> ", F.col("n_files"), " files across ", F.col("n_modules"), " modules.\n\n",
        F.when(F.col("first_changed").isNotNull(), _text("## Recently changed\n\n- `", F.replace("first_changed", F.lit(", "), F.lit("`\n- `")), "`\n\n")), "## Modules\n\n",
    )
    line = _text("- [", F.col("module"), "](./modules/", F.col("module"), ".md) — ", F.col("n_files"), " files")
    rows = _rows(c.visible_modules(files), ["repo"], "place", ["place"], line)
    one, title = F.lit("index"), F.lit("Code Index")
    out = _parts(heads, "index", one, title, "x", F.lit(0), head).unionByName(_parts(rows, "index", one, title, "x", F.col("part"), F.col("body")))
    return out.withColumn("path", F.lit("INDEX.md"))


def graph_summaries(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Importers and imports of the file of every symbol, as parts of one page per file: part 0 the counts, then one row
    per link. id is the file, as all symbols of a file share the page."""
    f = symbols.where("id <> ''").select("repo", F.substring_index("id", "::", 1).alias("file")).distinct()
    links = c.dependents(edges)
    up = f.join(links.withColumnRenamed("path", "file"), ["repo", "file"]).select("repo", "file", F.lit(0).alias("side"), "edge_ord", "edge_key", F.concat(F.lit("- "), "importer").alias("line"))
    out = edges.select("repo", F.col("from_path").alias("file"), F.lit(1).alias("side"), "edge_ord", "edge_key", _text("- `", F.col("to_path"), "`").alias("line"))
    down = f.join(out, ["repo", "file"]).select("repo", "file", "side", "edge_ord", "edge_key", "line")
    n = up.unionByName(down).groupBy("repo", "file").agg(F.count_if(F.col("side") == 0).alias("n_up"), F.count_if(F.col("side") == 1).alias("n_down"))
    head = _text("# Graph: ", F.col("file"), "\n\nImported by: ", F.coalesce("n_up", F.lit(0)), "\nImports: ", F.coalesce("n_down", F.lit(0)), "\n")
    heads = f.join(n, ["repo", "file"], "left").select("repo", "file", F.lit(-1).alias("side"), F.lit(0).alias("edge_ord"), F.lit(0).cast("long").alias("edge_key"), head.alias("line"))
    return heads.unionByName(up).unionByName(down)


def whole(parts: DataFrame, most: int = WHOLE_PARTS) -> DataFrame:
    """Pages of at most most parts as one row each; longer ones stay in parts and are written as such."""
    n = parts.groupBy("repo", "path").agg(F.max("part").alias("last"))
    few = parts.join(n.where(F.col("last") < most).select("repo", "path"), ["repo", "path"], "left_semi")
    g = few.groupBy("repo", "kind", "id", "title", "path").agg(F.array_sort(F.collect_list(F.struct("part", "body"))).alias("p"))
    return g.select("repo", "kind", "id", "title", "path", F.array_join(F.transform("p", lambda x: x["body"]), "").alias("body"))


def page_tokens(parts: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """repo, path and tokens of every page: the sum over its parts, which all end in a line break."""
    return parts.select("repo", "path", n_tokens(F.col("body"), vocabulary).alias("n")).groupBy("repo", "path").agg(F.sum("n").alias("tokens"))


def with_front_matter(parts: DataFrame, generated_at: str, generator: str = "codeloom/0.1", vocabulary: str = VOCABULARY) -> DataFrame:
    """Parts of pages whose heads begin with YAML: kind, id, title, path, tokens, stale, generatedAt, generator, and the
    source of the pages of files."""
    sizes = page_tokens(parts, vocabulary)
    heads = parts.where("part = 0").join(sizes, ["repo", "path"])
    source = F.when(F.col("kind") == "file", _text("\n  source:\n    repoPath: ", yaml_string(F.col("id")), "\n    language: ", yaml_string(F.col("language")), "\n    module: null"))
    yaml = _text(
        "---\nkind: ", F.col("kind"), "\nid: ", yaml_string(F.col("id")), "\ntitle: ", yaml_string(F.col("title")), "\npath: ", yaml_string(F.col("path")), "\ntokens: ", F.col("tokens"),
        "\nstale: false\ngeneratedAt: ", yaml_string(F.lit(generated_at)), "\ngenerator: ", yaml_string(F.lit(generator)), source, "\n---\n",
    )
    return heads.select("repo", "kind", "id", "title", "path", "part", F.concat(yaml, "body").alias("body")).unionByName(parts.where("part > 0").drop("language"))


def write_pages(parts: DataFrame, folder: str) -> None:
    """Parts of pages as a table of the shared folder, one directory per kind; rewriting it replaces it as a whole."""
    parts.write.mode("overwrite").partitionBy("kind").parquet(folder)


def page_heads(parts: DataFrame) -> DataFrame:
    """Number of pages per repository and kind."""
    return parts.where("part = 0").groupBy("repo", "kind").agg(F.count("*").alias("n_pages"))
