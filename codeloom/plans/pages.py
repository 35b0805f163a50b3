"""Queries over texts and pages: symbols and imports read from the texts, Markdown pages, exports, state of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import globs
from codeloom.functions.tokens import n_tokens, truncated
from codeloom.operators import catalog as c
from codeloom.operators import exports, extract, pages
from codeloom.plans.catalog import _WITH, _edges, _files, _symbols
from codeloom.session import table
from codeloom.streaming import changes


def extract_symbols(s: SparkSession, d: str) -> DataFrame:
    return extract.symbols(table(s, d, "documents"))


def extract_imports(s: SparkSession, d: str) -> DataFrame:
    return extract.imports(table(s, d, "documents"))


def symbols_per_language(s: SparkSession, d: str) -> DataFrame:
    """Symbols found in the texts by language, kind and visibility."""
    g = extract_symbols(s, d).groupBy("language", "kind", "visibility")
    return g.agg(F.count("*").alias("n_symbols"), F.count("docstring").alias("n_documented"), F.max("complexity").alias("most_complex"))


def extraction_vs_index(s: SparkSession, d: str) -> DataFrame:
    """Symbols of the index whose file has a text, by extension, and how many of them extraction finds with the same kind,
    name and lines."""
    keys = ["file_id", "kind", "name", "line_start", "line_end"]
    texts = table(s, d, "documents").where("kind = 'source' AND text <> ''").select("file_id").distinct()
    index = _symbols(s, d).join(texts, "file_id", "left_semi")
    found = extract_symbols(s, d).select(*keys).distinct().withColumn("hit", F.lit(1))
    g = index.join(found, keys, "left").groupBy(F.regexp_extract("file", r"\.([^./]+)$", 1).alias("extension"))
    return g.agg(F.count("*").alias("n_symbols"), F.count("hit").alias("n_found"))


def invalidated(s: SparkSession, d: str) -> DataFrame:
    """State of the last build with the files marked whose text has changed since."""
    state = table(s, d, "index_state").select("repo", "repo_path", "hash", "public_signature_changed")
    changed = c.state_diff(_files(s, d), state).where("change = 'changed'")
    return changes.invalidated(state, changed)


def all_pages(s: SparkSession, d: str) -> DataFrame:
    f, y, e = _files(s, d), _symbols(s, d), _edges(s, d)
    changed = c.changed_since(c.state_diff(f, table(s, d, "index_state")))
    out = pages.symbol_pages(y)
    for more in (pages.file_pages(f, y), pages.module_pages(f, y, e), pages.architecture_pages(f, y, e), pages.index_pages(f, y, changed)):
        out = out.unionByName(more)
    return out


def _bodies(parts: DataFrame) -> DataFrame:
    return parts.select("repo", "path", "part", "body")


QUERIES = {
    "extract_symbols": extract_symbols,
    "extract_imports": extract_imports,
    "symbols_per_language": symbols_per_language,
    "extraction_vs_index": extraction_vs_index,
    "symbol_pages": lambda s, d: _bodies(pages.symbol_pages(_symbols(s, d))),
    "file_pages": lambda s, d: _bodies(pages.file_pages(_files(s, d), _symbols(s, d))),
    "module_pages": lambda s, d: _bodies(pages.module_pages(_files(s, d), _symbols(s, d), _edges(s, d))),
    "architecture_pages": lambda s, d: _bodies(pages.architecture_pages(_files(s, d), _symbols(s, d), _edges(s, d))),
    "index_pages": lambda s, d: _bodies(pages.index_pages(_files(s, d), _symbols(s, d), c.changed_since(c.state_diff(_files(s, d), table(s, d, "index_state"))))),
    "graph_summaries": lambda s, d: pages.graph_summaries(_symbols(s, d), _edges(s, d)),
    "whole_pages": lambda s, d: pages.whole(pages.file_pages(_files(s, d), _symbols(s, d))).select("repo", "path", "title", "body"),
    "page_texts": lambda s, d: pages.with_front_matter(all_pages(s, d), "2024-01-01T00:00:00.000Z"),
    "page_heads": lambda s, d: pages.page_heads(all_pages(s, d)),
    "document_tokens": lambda s, d: table(s, d, "documents").groupBy("source", "kind").agg(F.sum(n_tokens(F.col("text"))).alias("n_tokens")),
    "document_starts": lambda s, d: table(s, d, "documents").select("doc_id", truncated(F.col("text"), 50).alias("start")),
    "prompt_symbols": lambda s, d: exports.prompt_symbols(_files(s, d), _symbols(s, d)),
    "prompt_files": lambda s, d: exports.prompt_files(_files(s, d)),
    "export_meta": lambda s, d: exports.meta(_files(s, d), _symbols(s, d), "2024-01-01T00:00:00.000Z"),
    "export_index": lambda s, d: exports.index_lines(_files(s, d), _symbols(s, d)),
    "export_graph": lambda s, d: exports.graph_lines(_edges(s, d)),
    "kept_files": lambda s, d: _files(s, d).where(~globs.ignored(F.col("repo_path"), globs.rules(globs.DEFAULT_IGNORES))).select("file_id", "repo_path"),
    "schema_versions": lambda s, d: exports.valid(exports.meta(_files(s, d), _symbols(s, d), "2024-01-01T00:00:00.000Z")),
    "invalidated": invalidated,
    "annotated": lambda s, d: changes.annotated(table(s, d, "imports").select("edge_key", "repo", F.col("from_path").alias("repo_path")), _files(s, d)).select("edge_key", "repo_path", "file_id", "tokens"),
    "annotated_pages": lambda s, d: changes.with_page(table(s, d, "imports").select("edge_key", "repo", F.col("to_path").alias("repo_path")), _files(s, d)).select("edge_key", "repo_path", "has_page"),
    "settled": lambda s, d: changes.settled(table(s, d, "events").selectExpr("event_type AS path", "ts", "value AS size"), "ts", "2 minutes"),
}

_JOIN = "string_agg({0}, chr(10) ORDER BY {1}) || chr(10)"
_HEAD = _WITH + """, lst AS (SELECT repo, id, arg_max({'n': name, 'f': file, 'g': signature, 'a': line_start, 'b': line_end, 'd': docstring, 'v': visibility, 'c': complexity}, {'o': symbol_ord, 'k': symbol_key}) AS x FROM s WHERE id IS NOT NULL GROUP BY repo, id),
n AS (SELECT file_id, count(*) AS n_symbols, count(*) FILTER (visibility = 'public') AS n_public FROM s GROUP BY file_id),
fn AS (SELECT f.*, coalesce(n_symbols, 0) AS n_symbols, coalesce(n_public, 0) AS n_public FROM f LEFT JOIN n USING (file_id)),
pub AS (SELECT s.repo, module, kind || ' ' || name AS t, row_number() OVER (PARTITION BY s.repo, module ORDER BY file_ord NULLS FIRST, symbol_ord NULLS FIRST, symbol_key) AS k FROM s JOIN f USING (file_id) WHERE visibility = 'public'),
ov AS (SELECT f.repo, count(*) AS n_files, coalesce(any_value(v.n), 0) AS n_modules, coalesce(any_value(y.n), 0) AS n_symbols FROM f LEFT JOIN (SELECT repo, count(*) AS n FROM vis GROUP BY repo) v ON f.repo = v.repo LEFT JOIN (SELECT repo, count(*) AS n FROM s GROUP BY repo) y ON f.repo = y.repo GROUP BY f.repo)
"""
_CELL = "left(replace(replace(coalesce(signature, ''), '|', '\\|'), chr(10), ' '), 200)"
_FILE_PAGES = """
SELECT repo, 'files/' || repo_path || '.md' AS path, 0 AS part, '# File: ' || repo_path || chr(10) || chr(10) || CASE WHEN summary <> '' THEN '> ' || summary || chr(10) ELSE '' END || chr(10) || '- **Language**: ' || coalesce(language, 'unknown') || chr(10)
  || '- **Size**: ' || coalesce(size::VARCHAR, '') || ' bytes' || chr(10) || '- **Symbols**: ' || n_symbols || chr(10) || chr(10)
  || CASE WHEN n_symbols > 0 THEN '## Symbols' || chr(10) || chr(10) || '| Name | Kind | Lines | Signature |' || chr(10) || '| --- | --- | --- | --- |' ELSE '_No symbols extracted (language not yet supported or file is empty)._' END || chr(10) AS body FROM fn
UNION ALL SELECT f.repo, 'files/' || f.repo_path || '.md', greatest(coalesce(symbol_ord, 0) // 500, 0) + 1, """ + _JOIN.format("'| ' || coalesce(name, '') || ' | ' || coalesce(kind, '') || ' | ' || coalesce(line_start::VARCHAR, '') || '-' || coalesce(line_end::VARCHAR, '') || ' | `' || " + _CELL + " || '` |'", "symbol_ord NULLS FIRST, symbol_key") + """
  FROM s JOIN f USING (file_id) GROUP BY f.file_id, f.repo, f.repo_path, 3"""
_MODULE_HEADS = """,
surf AS (SELECT repo, module, string_agg(t, '`' || chr(10) || '- `' ORDER BY k) FILTER (k <= 20) AS t, greatest(count(*) - 20, 0) AS more FROM pub GROUP BY repo, module),
nb AS (SELECT repo, fm AS module, 0 AS d, tm AS other, first FROM me UNION ALL SELECT repo, tm, 1, fm, first FROM me),
nd AS (SELECT repo, module, d, other, row_number() OVER (PARTITION BY repo, module, d ORDER BY first, other) - 1 AS p FROM nb),
dia AS (SELECT repo, module, string_agg(CASE d WHEN 0 THEN '  out' || p || '["' || other || '"]' || chr(10) || '  this --> out' || p ELSE '  in' || p || '["' || other || '"]' || chr(10) || '  in' || p || ' --> this' END || chr(10), '' ORDER BY d, p) AS t FROM nd GROUP BY repo, module),
mods AS (SELECT repo, module, count(*) AS n_files, sum(n_public)::BIGINT AS n_public FROM fn WHERE module NOT IN ('_tests', '_root') GROUP BY repo, module)
"""

SQL = {
    "extraction_vs_index": _WITH + "SELECT regexp_extract(file, '[.]([^./]+)$', 1) AS extension, count(*) AS n_symbols, count(*) AS n_found FROM s SEMI JOIN (SELECT file_id FROM documents WHERE kind = 'source' AND text <> '') t USING (file_id) GROUP BY 1",
    "symbol_pages": _HEAD + """SELECT repo, 'symbols/' || split_part(id, '::', 1) || CASE WHEN contains(id, '::') THEN '/' || substr(id, strpos(id, '::') + 2) ELSE '' END || '.md' AS path, 0 AS part,
      '# ' || coalesce(x.n, '') || chr(10) || chr(10) || '`' || coalesce(x.f, '') || ':' || coalesce(x.a::VARCHAR, '') || '-' || coalesce(x.b::VARCHAR, '') || '`' || chr(10) || chr(10) || '```'
      || CASE regexp_extract(coalesce(x.f, ''), '[.]([^./]+)$', 1) WHEN 'ts' THEN 'ts' WHEN 'tsx' THEN 'tsx' WHEN 'js' THEN 'js' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' WHEN 'rb' THEN 'ruby' WHEN 'c' THEN 'c' WHEN 'cpp' THEN 'cpp' ELSE '' END
      || chr(10) || coalesce(x.g, '') || chr(10) || '```' || chr(10) || CASE WHEN x.d <> '' THEN chr(10) || x.d || chr(10) ELSE '' END || chr(10) || 'visibility: ' || coalesce(x.v, 'unknown') || ', complexity: ' || coalesce(x.c, 1) || chr(10) AS body FROM lst""",
    "file_pages": _HEAD + _FILE_PAGES,
    "whole_pages": _HEAD + ", parts AS (" + _FILE_PAGES + ") SELECT repo, path, regexp_replace(path, '^files/(.*)[.]md$', '\\1') AS title, string_agg(body, '' ORDER BY part) AS body FROM parts GROUP BY repo, path HAVING max(part) < 64",
    "module_pages": _HEAD + _MODULE_HEADS + """SELECT m.repo, 'modules/' || m.module || '.md' AS path, 0 AS part, '# Module: ' || m.module || chr(10) || chr(10) || '> ' || n_files || ' files, ' || n_public || ' public symbols.' || chr(10) || chr(10)
      || CASE WHEN dia.t IS NOT NULL THEN '## Dependencies' || chr(10) || chr(10) || '```mermaid' || chr(10) || 'graph LR' || chr(10) || '  this["' || m.module || '"]' || chr(10) || dia.t || '```' || chr(10) || chr(10) ELSE '' END
      || CASE WHEN surf.t IS NOT NULL THEN '## Public surface' || chr(10) || chr(10) || '- `' || surf.t || '`' || chr(10) || CASE WHEN more > 0 THEN '- _(' || more || ' more)_' || chr(10) ELSE '' END || chr(10) ELSE '' END
      || '## Files' || chr(10) || chr(10) || '| File | Summary | Symbols |' || chr(10) || '| --- | --- | --- |' || chr(10) AS body
      FROM mods m LEFT JOIN dia ON m.repo = dia.repo AND m.module = dia.module LEFT JOIN surf ON m.repo = surf.repo AND m.module = surf.module
      UNION ALL SELECT repo, 'modules/' || module || '.md', greatest(coalesce(file_ord, 0) // 500, 0) + 1, """ + _JOIN.format("'| [' || repo_path || '](./files/' || repo_path || '.md) | ' || left(replace(coalesce(summary, ''), '|', '\\|'), 120) || ' | ' || n_symbols || ' |'", "file_ord NULLS FIRST, repo_path, file_id") + """
      FROM fn WHERE module NOT IN ('_tests', '_root') GROUP BY repo, module, 3""",
    "architecture_pages": _HEAD + """, sh AS (SELECT * FROM vis WHERE place <= 30),
      se AS (SELECT me.*, row_number() OVER (PARTITION BY me.repo ORDER BY first, fm, tm) AS p FROM me SEMI JOIN sh a ON me.repo = a.repo AND me.fm = a.module SEMI JOIN sh b ON me.repo = b.repo AND me.tm = b.module QUALIFY p <= 30),
      nm AS (SELECT repo, string_agg('  ' || CASE WHEN module[1] BETWEEN '0' AND '9' THEN '_' ELSE '' END || regexp_replace(module, '[^a-zA-Z0-9]', '_', 'g') || '["' || module || '"]' || chr(10), '' ORDER BY place) AS t FROM sh GROUP BY repo),
      ar AS (SELECT repo, string_agg('  ' || CASE WHEN fm[1] BETWEEN '0' AND '9' THEN '_' ELSE '' END || regexp_replace(fm, '[^a-zA-Z0-9]', '_', 'g') || ' -->|' || weight || CASE weight WHEN 1 THEN ' edge| ' ELSE ' edges| ' END || CASE WHEN tm[1] BETWEEN '0' AND '9' THEN '_' ELSE '' END || regexp_replace(tm, '[^a-zA-Z0-9]', '_', 'g') || chr(10), '' ORDER BY p) AS t FROM se GROUP BY repo),
      od AS (SELECT repo, fm AS module, count(DISTINCT tm) AS n FROM em GROUP BY ALL), id AS (SELECT repo, tm AS module, count(DISTINCT fm) AS n FROM em GROUP BY ALL),
      sf AS (SELECT repo, module, '`' || string_agg(t, '`, `' ORDER BY k) FILTER (k <= 3) || '`...' AS t FROM pub GROUP BY repo, module)
      SELECT ov.repo, 'architecture.md' AS path, 0 AS part, '# Architecture' || chr(10) || chr(10) || '> ' || n_files || ' files, ' || n_modules || ' modules, ' || n_symbols || ' symbols.' || chr(10) || chr(10)
        || CASE WHEN nm.t IS NOT NULL THEN '## Module map' || chr(10) || chr(10) || '```mermaid' || chr(10) || 'graph LR' || chr(10) || nm.t || CASE WHEN n_modules > 30 THEN '  more["...(' || (n_modules - 30) || ' more)"]' || chr(10) ELSE '' END || coalesce(ar.t, '') || '```' || chr(10) || chr(10) ELSE '' END
        || '## Modules' || chr(10) || chr(10) || '| Module | Files | Public surface | Imports | Imported by |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) AS body
      FROM ov LEFT JOIN nm ON ov.repo = nm.repo LEFT JOIN ar ON ov.repo = ar.repo
      UNION ALL SELECT v.repo, 'architecture.md', (v.place // 500 + 1)::INT, """ + _JOIN.format("'| [' || v.module || '](./modules/' || v.module || '.md) | ' || v.n_files || ' | ' || coalesce(sf.t, '_Internal-only_') || ' | ' || coalesce(od.n, 0) || ' | ' || coalesce(id.n, 0) || ' |'", "v.place") + """
      FROM vis v LEFT JOIN sf ON v.repo = sf.repo AND v.module = sf.module LEFT JOIN od ON v.repo = od.repo AND v.module = od.module LEFT JOIN id ON v.repo = id.repo AND v.module = id.module GROUP BY v.repo, 3""",
    "index_pages": _HEAD + """, t AS (SELECT DISTINCT repo, repo_path, hash FROM index_state),
      x AS (SELECT coalesce(f.repo, t.repo) AS repo, coalesce(f.repo_path, t.repo_path) AS path FROM f FULL JOIN t ON f.repo = t.repo AND f.repo_path = t.repo_path WHERE t.repo IS NULL OR f.repo IS NULL OR content_hash IS DISTINCT FROM hash),
      r AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS k FROM x), ch AS (SELECT repo, string_agg('- `' || path || '`', chr(10) ORDER BY k) FILTER (k <= 20) AS t FROM r GROUP BY repo)
      SELECT ov.repo, 'INDEX.md' AS path, 0 AS part, '# Code Index' || chr(10) || chr(10) || '> ' || n_files || ' files across ' || n_modules || ' modules.' || chr(10) || chr(10) || CASE WHEN ch.t IS NOT NULL THEN '## Recently changed' || chr(10) || chr(10) || ch.t || chr(10) || chr(10) ELSE '' END || '## Modules' || chr(10) || chr(10) AS body
      FROM ov LEFT JOIN ch ON ov.repo = ch.repo
      UNION ALL SELECT repo, 'INDEX.md', (place // 500 + 1)::INT, """ + _JOIN.format("'- [' || module || '](./modules/' || module || '.md) — ' || n_files || ' files'", "place") + " FROM vis GROUP BY repo, 3",
    "graph_summaries": _WITH + """, fl AS (SELECT DISTINCT repo, split_part(id, '::', 1) AS file FROM s WHERE id <> ''),
      up AS (SELECT fl.repo, fl.file, 0 AS side, edge_ord, edge_key, '- ' || from_path AS line FROM fl JOIN e ON fl.repo = e.repo AND fl.file = e.to_path QUALIFY row_number() OVER (PARTITION BY fl.repo, fl.file, from_path ORDER BY edge_ord NULLS FIRST, edge_key) = 1),
      dn AS (SELECT fl.repo, fl.file, 1 AS side, edge_ord, edge_key, '- `' || to_path || '`' AS line FROM fl JOIN e ON fl.repo = e.repo AND fl.file = e.from_path)
      SELECT * FROM up UNION ALL SELECT * FROM dn UNION ALL SELECT repo, file, -1, 0, 0, '# Graph: ' || file || chr(10) || chr(10) || 'Imported by: ' || (SELECT count(*) FROM up WHERE up.repo = fl.repo AND up.file = fl.file) || chr(10) || 'Imports: ' || (SELECT count(*) FROM dn WHERE dn.repo = fl.repo AND dn.file = fl.file) || chr(10) FROM fl""",
    "page_heads": _HEAD + """SELECT repo, 'symbol' AS kind, count(*) AS n_pages FROM lst GROUP BY repo UNION ALL SELECT repo, 'file', count(*) FROM f GROUP BY repo UNION ALL SELECT repo, 'module', count(*) FROM vis GROUP BY repo
      UNION ALL SELECT repo, unnest(['architecture', 'index']), 1 FROM ov""",
    "prompt_symbols": _WITH + """, r AS (SELECT s.file_id, row_number() OVER (PARTITION BY s.file_id ORDER BY symbol_ord NULLS FIRST, symbol_key) AS k, '[' || coalesce(kind, '') || '] ' || coalesce(signature, '') || CASE WHEN docstring <> '' THEN ' — ' || docstring ELSE '' END AS t FROM s)
      SELECT r.file_id, string_agg(t, chr(10) ORDER BY k) AS symbols FROM r SEMI JOIN f USING (file_id) WHERE k <= 30 GROUP BY r.file_id""",
    "prompt_files": _WITH + """, r AS (SELECT repo, module, row_number() OVER (PARTITION BY repo, module ORDER BY file_ord NULLS FIRST, repo_path, file_id) AS k, repo_path || CASE WHEN summary <> '' THEN ': ' || summary ELSE '' END AS t FROM f)
      SELECT repo, module, string_agg(t, chr(10) ORDER BY k) AS files FROM r WHERE k <= 12 GROUP BY repo, module""",
    "export_meta": _HEAD + """, lang AS (SELECT repo, string_agg(DISTINCT '"' || coalesce(language, 'unknown') || '"', ',' ORDER BY '"' || coalesce(language, 'unknown') || '"') AS t FROM f GROUP BY repo)
      SELECT repo, '{"schemaVersion":1,"updatedAt":"2024-01-01T00:00:00.000Z","fileCount":' || n_files || ',"moduleCount":' || n_modules || ',"symbolCount":' || n_symbols || ',"languages":[' || t || ']}' AS json FROM ov JOIN lang USING (repo)""",
    "schema_versions": _WITH + "SELECT DISTINCT repo, true AS valid FROM f",
    "export_index": _HEAD + """SELECT repo, 'modules' AS kind, to_json({'id': module, 'path': 'modules/' || module || '.md', 'files': n_files})::VARCHAR AS json FROM (SELECT repo, module, count(*) AS n_files FROM f WHERE module <> '_tests' GROUP BY repo, module)
      UNION ALL SELECT repo, 'files', to_json({'path': repo_path, 'module': CASE module WHEN '_tests' THEN '_root' ELSE module END, 'language': language, 'symbols': n_symbols, 'publicSymbols': n_public, 'tokens': greatest(50, floor(coalesce(size, 0) / 4 + 0.5))::BIGINT})::VARCHAR FROM fn
      UNION ALL SELECT repo, 'symbols', to_json({'id': id, 'name': name, 'kind': kind, 'file': file, 'line': line_start, 'visibility': visibility, 'tokens': 150})::VARCHAR FROM s""",
    "export_graph": _WITH + """SELECT repo, 'imports' AS kind, to_json({'from': from_path, 'to': to_path, 'ord': edge_ord})::VARCHAR AS json FROM e
      UNION ALL SELECT repo, 'dependents', to_json({'path': to_path, 'importer': from_path})::VARCHAR FROM (SELECT DISTINCT repo, to_path, from_path FROM e)""",
    "kept_files": _WITH + """SELECT file_id, repo_path FROM f WHERE repo_path IS NOT NULL AND len(list_intersect(string_split(regexp_replace(repo_path, '[^/]*$', ''), '/'), ['node_modules', 'dist', 'build', '.next', '.turbo', 'coverage', 'target', '__pycache__', '.venv', 'venv'])) = 0
      AND NOT regexp_matches(repo_path, '([.]min[.]js|[.]lock|[.]wasm)(/.+)?$') AND len(list_intersect(string_split(repo_path, '/'), ['package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'Cargo.lock'])) = 0 AND len(list_filter(string_split(repo_path, '/'), lambda x: regexp_matches(x, '([.]min[.]js|[.]lock|[.]wasm)$'))) = 0""",
    "invalidated": _WITH + """, t AS (SELECT DISTINCT repo, repo_path, hash FROM index_state),
      ch AS (SELECT DISTINCT f.repo, f.repo_path FROM f JOIN t ON f.repo = t.repo AND f.repo_path = t.repo_path WHERE content_hash IS DISTINCT FROM hash)
      SELECT i.repo, i.repo_path, i.hash, CASE WHEN ch.repo IS NOT NULL THEN true ELSE public_signature_changed END AS public_signature_changed
      FROM index_state i LEFT JOIN ch ON i.repo = ch.repo AND i.repo_path = ch.repo_path""",
    "annotated": _WITH + """SELECT edge_key, from_path AS repo_path, file_id, CASE WHEN file_id IS NULL THEN 600 ELSE greatest(50, floor(coalesce(size, 0) / 4 + 0.5)) END::BIGINT AS tokens
      FROM imports i LEFT JOIN f ON i.repo = f.repo AND i.from_path = f.repo_path""",
    "annotated_pages": _WITH + "SELECT edge_key, to_path AS repo_path, EXISTS (SELECT 1 FROM f WHERE f.repo = i.repo AND f.repo_path = i.to_path) AS has_page FROM imports i",
    "settled": """WITH g AS (SELECT event_type AS path, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 2 MINUTE THEN 0 ELSE 1 END AS n FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL),
      h AS (SELECT path, ts, value, sum(n) OVER (PARTITION BY path ORDER BY ts) AS k FROM g)
      SELECT path, max(ts) + INTERVAL 2 MINUTE AS settled_at, count(*) AS n_changes, arg_max(value, {'t': ts, 'v': value}) AS size FROM h GROUP BY path, k""",
}
