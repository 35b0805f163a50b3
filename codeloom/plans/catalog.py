"""Queries over the index: files, modules, graph, search, freshness; each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import catalog as c
from codeloom.session import table


def _files(s: SparkSession, d: str) -> DataFrame:
    return c.live_files(table(s, d, "files"))


def _symbols(s: SparkSession, d: str) -> DataFrame:
    return c.symbols_once(table(s, d, "symbols"))


def _edges(s: SparkSession, d: str) -> DataFrame:
    return c.edges_once(table(s, d, "imports"))


def _entries(s: SparkSession, d: str) -> DataFrame:
    return c.entries(_files(s, d), _symbols(s, d))


def _order(columns: list[str]) -> str:
    return ", ".join(f"{x} NULLS FIRST" for x in columns)


_TEST = """(starts_with({0}, '__tests__/') OR contains({0}, '/__tests__/') OR starts_with({0}, 'spec/') OR contains({0}, '/spec/')
  OR regexp_matches({0}, '[.](test|spec)[.][a-z]+$') OR regexp_matches({0}, '^(.*/)?test_.+[.][a-z]+$') OR regexp_matches({0}, '^.+_test[.][a-z]+$') AND NOT regexp_matches({0}, '^(.*/)?_test[.][a-z]+$'))"""
_MODULE = f"CASE WHEN {_TEST} THEN '_tests' WHEN {{0}} = '' OR starts_with({{0}}, '/') THEN '_root' ELSE split_part({{0}}, '/', 1) END"
_WITH = f"""WITH gone AS (SELECT file_id FROM files GROUP BY file_id HAVING max(deleted_at) IS NOT NULL),
f AS (SELECT *, {_MODULE.format("repo_path")} AS module FROM (SELECT * FROM files WHERE file_id IS NOT NULL AND NOT coalesce(starts_with(repo_path, '.git/'), false) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY {_order(c.FILE)}) = 1) ANTI JOIN gone USING (file_id)),
s AS (SELECT * FROM symbols WHERE symbol_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_key ORDER BY {_order(c.SYMBOL)}) = 1),
e AS (SELECT * FROM (SELECT * FROM imports WHERE edge_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY edge_key ORDER BY {_order(c.EDGE)}) = 1) WHERE from_path <> '' AND to_path <> ''),
em AS (SELECT repo, {_MODULE.format("from_path")} AS fm, {_MODULE.format("to_path")} AS tm, edge_ord, edge_key FROM e),
entry AS (SELECT DISTINCT repo, 0 AS band, 'module' AS kind, module AS id, module AS name, NULL::VARCHAR AS file, module FROM f WHERE module <> '_tests'
  UNION ALL SELECT repo, 1, 'file', repo_path, repo_path, repo_path, CASE module WHEN '_tests' THEN '_root' ELSE module END FROM f UNION ALL SELECT repo, 2, kind, id, name, file, NULL FROM s),
vis AS (SELECT repo, module, count(*) AS n_files, row_number() OVER (PARTITION BY repo ORDER BY module) AS place FROM f WHERE module NOT IN ('_tests', '_root') GROUP BY repo, module),
me AS (SELECT repo, fm, tm, count(*) AS weight, min({{'a': edge_ord, 'b': edge_key}}) AS first FROM em WHERE fm <> tm GROUP BY ALL)
"""

def _wanted(s: SparkSession, d: str) -> DataFrame:
    """Ids that imports, parents of symbols and names of modules ask for."""
    imports, symbols, files = _edges(s, d), _symbols(s, d), _files(s, d)
    return imports.select("repo", F.col("to_path").alias("id")).unionByName(symbols.select("repo", F.col("parent_id").alias("id"))).unionByName(files.select("repo", F.col("module").alias("id")))


def _routes(s: SparkSession, d: str) -> DataFrame:
    """Addresses of all entries and the pages that they name."""
    kind = F.when(F.col("band") == 0, "module").when(F.col("band") == 1, "file").otherwise("symbol")
    e = _entries(s, d).where("id <> ''").select("band", kind.alias("kind"), "id").distinct()
    uri = F.concat(F.lit("wiki://"), "kind", F.lit("/"), "id", F.lit("?cursor="), (F.col("band") * 50).cast("string"))
    return e.select("kind", "id", c.routed(uri).alias("path"), c.cursor(uri).alias("first_row"))


_WANTED = ", w AS (SELECT repo, to_path AS id FROM e UNION SELECT repo, parent_id FROM s WHERE parent_id IS NOT NULL UNION SELECT repo, module FROM f)"

QUERIES = {
    "file_index": lambda s, d: table(s, d, "documents").where("kind = 'source'").select(
        "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n_lines"), F.greatest(F.lit(50), F.floor(F.octet_length(F.coalesce("text", F.lit(""))) / 4 + 0.5)).cast("long").alias("tokens")),
    "language_counts": lambda s, d: _files(s, d).groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes")),
    "modules": lambda s, d: _files(s, d).groupBy("repo", "module").agg(F.count("*").alias("n_files"), F.min("repo_path").alias("first_file")),
    "visible_modules": lambda s, d: c.visible_modules(_files(s, d)).orderBy("repo", "place"),
    "test_files": lambda s, d: _files(s, d).where(c.is_test(F.col("repo_path"))).select("file_id", "repo_path"),
    "index_totals": lambda s, d: _symbols(s, d).groupBy("repo").agg(F.count("*").alias("n_symbols"), F.count_if(F.col("visibility") == "public").alias("n_public"), F.max("complexity").alias("most_complex")),
    "dependents": lambda s, d: c.dependents(_edges(s, d)),
    "module_edges": lambda s, d: c.module_edges(_edges(s, d)),
    "out_degree": lambda s, d: c.degrees(_edges(s, d), "out"),
    "in_degree": lambda s, d: c.degrees(_edges(s, d), "in"),
    "top_edges": lambda s, d: c.shown_edges(_edges(s, d), _files(s, d)),
    "neighbours": lambda s, d: c.neighbours(_edges(s, d)),
    "search": lambda s, d: c.search(_entries(s, d), " Ladle", 20),
    "list_page": lambda s, d: c.page(_entries(s, d), 3),
    "module_members": lambda s, d: _files(s, d).join(_symbols(s, d).groupBy("file_id").agg(F.count("*").alias("n")), "file_id", "left").select("repo", "module", "repo_path", F.coalesce("n", F.lit(0)).alias("n_symbols")),
    "page_last_wins": lambda s, d: c.last_per_page(_symbols(s, d)),
    "public_surface": lambda s, d: c.public_surface(_symbols(s, d), _files(s, d)),
    "worth_summary": lambda s, d: c.worth_summary(_symbols(s, d), _files(s, d)),
    "member_hash": lambda s, d: c.member_hash(_files(s, d)),
    "state_diff": lambda s, d: c.state_diff(_files(s, d), table(s, d, "index_state")),
    "stale_files": lambda s, d: c.stale_files(_files(s, d), table(s, d, "index_state")),
    "cache_miss": lambda s, d: c.cache_miss(_files(s, d), table(s, d, "index_state").select(c.summary_key(F.col("hash")).alias("key"))),
    "debounce": lambda s, d: c.sessions(table(s, d, "events"), "user_id", "ts", "30 minutes"),
    "dependent_counts": lambda s, d: c.dependent_counts(c.dependents(_edges(s, d))),
    "visible_edges": lambda s, d: c.visible_edges(_edges(s, d), c.visible_modules(_files(s, d))).drop("first"),
    "diagram_nodes": lambda s, d: c.diagram_nodes(_edges(s, d)),
    "diagram_ids": lambda s, d: c.visible_modules(_files(s, d)).select("repo", "module", c.diagram_id(F.col("module")).alias("node")),
    "files_by_path": lambda s, d: _files(s, d).select("file_id", "repo", "repo_path", c.top_level_dir(F.col("repo_path")).alias("folder")).orderBy("repo", "repo_path"),
    "module_files": lambda s, d: _files(s, d).select("repo", "module", "file_ord", "repo_path").orderBy("repo", "module", "file_ord"),
    "search_kind": lambda s, d: c.search(_entries(s, d), "on", 50, "file"),
    "public_surface_20": lambda s, d: c.public_surface(_symbols(s, d), _files(s, d), 20),
    "documentation": lambda s, d: c.documentation(_symbols(s, d), _files(s, d)),
    "summary_keys": lambda s, d: _files(s, d).select("file_id", c.summary_key(F.col("content_hash")).alias("key"), c.short_hash(F.col("repo_path")).alias("short")),
    "static_summary": lambda s, d: c.static_summary(table(s, d, "documents").where("kind = 'source' AND file_id IS NOT NULL").select("file_id", "repo_path", "text"), _symbols(s, d)),
    "summary_json": lambda s, d: table(s, d, "documents").select("doc_id", c.summary_json(F.coalesce("text", F.lit("")))[0].alias("purpose"), c.summary_json(F.coalesce("text", F.lit("")))[1].alias("notes")),
    "member_digest": lambda s, d: c.member_digest(_files(s, d)),
    "changed_since": lambda s, d: c.changed_since(c.state_diff(_files(s, d), table(s, d, "index_state"))),
    "file_changes": lambda s, d: c.file_changes(_files(s, d), F.lit("2024-06-01 00:00:00").cast("timestamp")),
    "page_lookup": lambda s, d: c.page_lookup(_wanted(s, d), _files(s, d), _symbols(s, d)),
    "resource_routes": _routes,
    "callers": lambda s, d: c.links_of(_symbols(s, d), _edges(s, d), "callers"),
    "callees": lambda s, d: c.links_of(_symbols(s, d), _edges(s, d), "callees"),
    "stale_counts": lambda s, d: c.stale_counts(_files(s, d), table(s, d, "index_state")),
}

SQL = {
    "file_index": "SELECT doc_id, sha256(coalesce(text, '')) AS hash, length(coalesce(text, '')) AS n_chars, len(string_split(coalesce(text, ''), chr(10))) AS n_lines, greatest(50, floor(strlen(coalesce(text, '')) / 4 + 0.5))::BIGINT AS tokens FROM documents WHERE kind = 'source'",
    "language_counts": _WITH + "SELECT coalesce(language, 'unknown') AS language, count(*) AS n_files, sum(size)::BIGINT AS bytes FROM f GROUP BY 1",
    "modules": _WITH + "SELECT repo, module, count(*) AS n_files, min(repo_path) AS first_file FROM f GROUP BY ALL",
    "visible_modules": _WITH + "SELECT repo, module, n_files, place FROM vis",
    "test_files": _WITH + f"SELECT file_id, repo_path FROM f WHERE {_TEST.format('repo_path')}",
    "index_totals": _WITH + "SELECT repo, count(*) AS n_symbols, count(*) FILTER (visibility = 'public') AS n_public, max(complexity) AS most_complex FROM s GROUP BY repo",
    "dependents": _WITH + "SELECT repo, to_path AS path, from_path AS importer, edge_ord, edge_key FROM e QUALIFY row_number() OVER (PARTITION BY repo, to_path, from_path ORDER BY edge_ord NULLS FIRST, edge_key) = 1",
    "module_edges": _WITH + "SELECT repo, fm AS from_module, tm AS to_module, count(*) AS weight FROM em WHERE fm <> tm GROUP BY ALL",
    "out_degree": _WITH + "SELECT repo, fm AS module, count(DISTINCT tm) AS out_degree FROM em GROUP BY ALL",
    "in_degree": _WITH + "SELECT repo, tm AS module, count(DISTINCT fm) AS in_degree FROM em GROUP BY ALL",
    "top_edges": _WITH + """, sh AS (SELECT repo, module FROM vis WHERE place <= 30)
      SELECT me.repo, row_number() OVER (PARTITION BY me.repo ORDER BY first, fm, tm) AS place, fm AS from_module, tm AS to_module, weight FROM me
      SEMI JOIN sh a ON me.repo = a.repo AND me.fm = a.module SEMI JOIN sh b ON me.repo = b.repo AND me.tm = b.module QUALIFY place <= 30""",
    "neighbours": _WITH + "SELECT repo, to_path AS path, 'caller' AS direction, from_path AS other FROM e UNION SELECT repo, from_path, 'callee', to_path FROM e",
    "search": _WITH + "SELECT * FROM entry WHERE contains(lower(name), 'ladle') ORDER BY band, repo NULLS FIRST, id NULLS FIRST, kind NULLS FIRST, name NULLS FIRST, file NULLS FIRST, module NULLS FIRST LIMIT 20",
    "list_page": _WITH + "SELECT * FROM entry ORDER BY band, repo NULLS FIRST, id NULLS FIRST, kind NULLS FIRST, name NULLS FIRST, file NULLS FIRST, module NULLS FIRST LIMIT 50 OFFSET 150",
    "module_members": _WITH + "SELECT f.repo, module, repo_path, count(s.symbol_key) AS n_symbols FROM f LEFT JOIN s USING (file_id) GROUP BY f.file_id, f.repo, module, repo_path",
    "page_last_wins": _WITH + "SELECT repo, id, last(symbol_key ORDER BY symbol_ord NULLS FIRST, symbol_key) AS symbol_key, count(*) AS n_written FROM s GROUP BY repo, id",
    "public_surface": _WITH + """, p AS (SELECT s.repo, module, kind, name, row_number() OVER (PARTITION BY s.repo, module ORDER BY file_ord NULLS FIRST, symbol_ord NULLS FIRST, symbol_key) AS k FROM s JOIN f USING (file_id) WHERE visibility = 'public')
      SELECT repo, module, count(*) AS n_public, string_agg(concat_ws(' ', kind, name), ', ' ORDER BY k) FILTER (k <= 3) AS surface, greatest(count(*) - 3, 0) AS n_more FROM p GROUP BY repo, module""",

    "member_hash": _WITH + "SELECT repo, module, sha256(string_agg(coalesce(content_hash, ''), '|' ORDER BY coalesce(content_hash, '')) || '|enrich-module') AS hash, count(*) AS n_files FROM f GROUP BY ALL",
    "state_diff": _WITH + ", t AS (SELECT DISTINCT repo, repo_path, hash FROM index_state) SELECT coalesce(f.repo, t.repo) AS repo, coalesce(f.repo_path, t.repo_path) AS repo_path, CASE WHEN t.repo IS NULL THEN 'added' WHEN f.repo IS NULL THEN 'removed' WHEN content_hash IS NOT DISTINCT FROM hash THEN 'same' ELSE 'changed' END AS change FROM f FULL JOIN t ON f.repo = t.repo AND f.repo_path = t.repo_path",
    "stale_files": _WITH + ", b AS (SELECT repo, epoch_us(max(last_indexed_at)) // 1000 AS built FROM index_state GROUP BY repo) SELECT f.repo, f.repo_path FROM f JOIN b ON f.repo = b.repo WHERE f.mtime_ms > built",
    "cache_miss": _WITH + "SELECT file_id, sha256(content_hash || '|enrich-file') AS key FROM f WHERE content_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM index_state i WHERE i.hash = f.content_hash)",
    "debounce": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events WHERE ts IS NOT NULL), h AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS started_at, count(*) AS n_events FROM h GROUP BY user_id, k",
    "dependent_counts": _WITH + "SELECT repo, to_path AS path, count(DISTINCT from_path) AS n_dependents FROM e GROUP BY repo, to_path",
    "visible_edges": _WITH + "SELECT repo, fm AS from_module, tm AS to_module, weight FROM me SEMI JOIN vis a ON me.repo = a.repo AND me.fm = a.module SEMI JOIN vis b ON me.repo = b.repo AND me.tm = b.module",
    "diagram_nodes": _WITH + """, n AS (SELECT repo, fm AS module, 'out' AS direction, tm AS other, first FROM me UNION ALL SELECT repo, tm, 'in', fm, first FROM me)
      SELECT repo, module, direction, row_number() OVER (PARTITION BY repo, module, direction ORDER BY first, other) - 1 AS place, other FROM n""",
    "diagram_ids": _WITH + "SELECT repo, module, CASE WHEN module[1] BETWEEN '0' AND '9' THEN '_' ELSE '' END || regexp_replace(module, '[^a-zA-Z0-9]', '_', 'g') AS node FROM vis",
    "files_by_path": _WITH + "SELECT file_id, repo, repo_path, CASE WHEN contains(repo_path, '/') THEN split_part(repo_path, '/', 1) ELSE '_root' END AS folder FROM f",
    "module_files": _WITH + "SELECT repo, module, file_ord, repo_path FROM f",
    "search_kind": _WITH + "SELECT * FROM entry WHERE band = 1 AND contains(lower(name), 'on') ORDER BY band, repo NULLS FIRST, id NULLS FIRST, kind NULLS FIRST, name NULLS FIRST, file NULLS FIRST, module NULLS FIRST LIMIT 50",
    "public_surface_20": _WITH + """, p AS (SELECT s.repo, module, kind, name, row_number() OVER (PARTITION BY s.repo, module ORDER BY file_ord NULLS FIRST, symbol_ord NULLS FIRST, symbol_key) AS k FROM s JOIN f USING (file_id) WHERE visibility = 'public')
      SELECT repo, module, count(*) AS n_public, string_agg(concat_ws(' ', kind, name), ', ' ORDER BY k) FILTER (k <= 20) AS surface, greatest(count(*) - 20, 0) AS n_more FROM p GROUP BY repo, module""",
    "documentation": _WITH + "SELECT file_id, count(*) AS n_symbols, bool_or(coalesce(docstring <> '', false)) AS documented, max(coalesce(complexity, 0)) AS most_complex FROM s SEMI JOIN (SELECT file_id FROM f WHERE language <> '') l USING (file_id) GROUP BY file_id",
    "summary_keys": _WITH + "SELECT file_id, sha256(content_hash || '|enrich-file') AS key, substr(sha256(repo_path), 1, 12) AS short FROM f",
    "static_summary": _WITH + r""", x AS (SELECT file_id, repo_path, string_split_regex(coalesce(text, ''), '\r?\n') AS lines FROM documents WHERE kind = 'source' AND file_id IS NOT NULL),
      y AS (SELECT file_id, repo_path, len(lines) AS n_lines, list_filter(list_transform(lines, lambda l: regexp_replace(l, '^[\s\x{a0}\x{feff}\x0b]+|[\s\x{a0}\x{feff}\x0b]+$', '', 'g')), lambda l: l <> '' AND NOT regexp_matches(l, '^(//|#|/\*|\*)'))[1] AS code FROM x),
      n AS (SELECT file_id, count(*) AS n, count(*) FILTER (visibility = 'public') AS p FROM s GROUP BY file_id)
      SELECT file_id, split_part(repo_path, '/', -1) || ': ' || concat_ws(', ', n_lines || ' lines', n || ' symbols (' || p || ' public)', 'starts: `' || left(code, 80) || '`') || '.' AS summary FROM y LEFT JOIN n USING (file_id)""",
    "summary_json": r"""WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS lines, regexp_extract(coalesce(text, ''), '\{[\s\S]*?\}') AS j FROM documents),
      p AS (SELECT doc_id, lines, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.purpose') END AS a, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.notes') END AS b FROM l)
      SELECT doc_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a ELSE left(coalesce(lines[1], ''), 200) END AS purpose,
        CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b ELSE left(coalesce(array_to_string(lines[2:], ' '), ''), 400) END AS notes FROM p""",
    "member_digest": _WITH + "SELECT repo, module, sha256(sum(('0x' || substr(sha256(coalesce(content_hash, '')), 1, 15))::HUGEINT)::VARCHAR || '|' || count(*) || '|enrich-module') AS digest, count(*) AS n_files FROM f GROUP BY ALL",
    "changed_since": _WITH + """, t AS (SELECT DISTINCT repo, repo_path, hash FROM index_state),
      x AS (SELECT coalesce(f.repo, t.repo) AS repo, coalesce(f.repo_path, t.repo_path) AS path FROM f FULL JOIN t ON f.repo = t.repo AND f.repo_path = t.repo_path WHERE t.repo IS NULL OR f.repo IS NULL OR content_hash IS DISTINCT FROM hash),
      r AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS k FROM x)
      SELECT repo, count(*) AS n_changed, string_agg(path, ', ' ORDER BY path) FILTER (k <= 20) AS first_changed FROM r GROUP BY repo""",
    "file_changes": _WITH + "SELECT repo, repo_path, mtime_ms FROM f WHERE mtime_ms > epoch_ms(TIMESTAMP '2024-06-01 00:00:00')",
    "page_lookup": _WITH + _WANTED + """, pg AS (SELECT repo, repo_path AS id, 0 AS rank FROM f UNION ALL SELECT repo, module, 1 FROM vis UNION ALL SELECT repo, id, 2 FROM s),
      b AS (SELECT repo, id, min(rank) AS rank FROM pg GROUP BY ALL)
      SELECT w.repo, w.id, CASE rank WHEN 0 THEN 'files/' || w.id || '.md' WHEN 1 THEN 'modules/' || w.id || '.md' WHEN 2 THEN 'symbols/' || split_part(w.id, '::', 1) || '/' || substr(w.id, strpos(w.id, '::') + 2) || '.md' END AS path
      FROM w LEFT JOIN b ON w.repo = b.repo AND w.id = b.id""",
    "resource_routes": _WITH + """SELECT kind, id, CASE band WHEN 0 THEN 'modules/' || id || '.md' WHEN 1 THEN 'files/' || id || '.md' ELSE 'symbols/' || id || '.md' END AS path, band * 50 AS first_row FROM (SELECT DISTINCT band, CASE band WHEN 0 THEN 'module' WHEN 1 THEN 'file' ELSE 'symbol' END AS kind, id FROM entry WHERE id <> '')""",
    "callers": _WITH + "SELECT DISTINCT s.repo, s.id, from_path AS other FROM s JOIN e ON s.repo = e.repo AND split_part(s.id, '::', 1) = e.to_path WHERE id <> ''",
    "callees": _WITH + "SELECT DISTINCT s.repo, s.id, to_path AS other FROM s JOIN e ON s.repo = e.repo AND split_part(s.id, '::', 1) = e.from_path WHERE id <> ''",
    "stale_counts": _WITH + ", b AS (SELECT repo, epoch_us(max(last_indexed_at)) // 1000 AS built FROM index_state GROUP BY repo) SELECT repo, count(*) AS n_files, count(*) FILTER (mtime_ms > built) AS n_stale, max(trunc(mtime_ms)::BIGINT - built) AS latest_ms FROM f JOIN b USING (repo) GROUP BY repo",
}
