"""Queries of problem 4: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.langs import EXTENSIONS
from codeloom.operators import orphans as o
from codeloom.session import table


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files, symbols, imports = (table(spark, sf_dir, t) for t in ("files", "symbols", "imports"))
    return o.references(imports, symbols), o.targets(files, symbols)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases from the state that is carried from quarter to quarter."""
    return o.maintained(*_inputs(spark, sf_dir))[0].select("ref_table", "ref_key", "ref_field")


def _rates(refs: DataFrame, found: DataFrame) -> DataFrame:
    month = F.date_format(F.col("at"), "yyyy-MM").alias("month")
    n = refs.groupBy("ref_table", "ref_field", month).agg(F.count("*").alias("n_refs"))
    k = found.groupBy("ref_table", "ref_field", month).agg(F.count("*").alias("n_orphans"))
    return n.join(k, ["ref_table", "ref_field", "month"], "left").select("ref_table", "ref_field", "month", "n_refs", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans and references per table, field and month of arrival."""
    refs, changes = _inputs(spark, sf_dir)
    return _rates(refs, o.maintained(refs, changes)[0])


def p4_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from a replay of all events at once, without state."""
    refs, changes = _inputs(spark, sf_dir)
    return _rates(refs, o.orphans(refs, changes))


def p4_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References still without target at the end of each month."""
    return o.open_orphans(*_inputs(spark, sf_dir)).select("ref_table", "ref_field", F.date_format("period", "yyyy-MM").alias("month"), "waiting")


def p4_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without target in the state at the end of each quarter with events."""
    out = None
    for period, counts in o.maintained(*_inputs(spark, sf_dir))[1]:
        rows = counts.select("ref_table", "ref_field", F.date_format(F.lit(period), "yyyy-MM").alias("quarter"), "waiting")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "ref_table string, ref_field string, quarter string, waiting long")


_EXT = ", ".join(f"('{e}')" for e in EXTENSIONS)
_NORM = r"regexp_replace(regexp_replace(regexp_replace(replace({0}, '\', '/'), '/{{2,}}', '/', 'g'), '^(\./)+', ''), '/$', '')"
_CASES = f"""
WITH ext(e) AS (VALUES {_EXT}),
i AS (SELECT * FROM imports WHERE ingested_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY edge_key ORDER BY ingested_at, repo, from_path, to_path) = 1),
s AS (SELECT * FROM symbols WHERE ingested_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol_key ORDER BY ingested_at, repo, parent_id) = 1),
f AS (SELECT file_id, repo, {_NORM.format("any_value(repo_path)")} AS path, min(ingested_at) AS came, max(deleted_at) AS gone FROM files GROUP BY file_id, repo),
t AS (SELECT symbol_key, repo, any_value(id) AS id, min(ingested_at) AS came, max(deleted_at) AS gone FROM symbols GROUP BY symbol_key, repo),
r AS (
  SELECT 'imports' AS ref_table, edge_key AS ref_key, 'from_path' AS ref_field, repo, {_NORM.format("from_path")} AS name, ingested_at AS arrived FROM i WHERE trim(from_path) <> ''
  UNION ALL SELECT 'imports', edge_key, 'to_path', repo, {_NORM.format("to_path")}, ingested_at FROM i WHERE is_relative AND trim(to_path) <> ''
  UNION ALL SELECT 'symbols', symbol_key, 'parent_id', repo, parent_id, ingested_at FROM s WHERE trim(parent_id) <> ''),
names AS (
  SELECT name, name AS path FROM r WHERE ref_field = 'to_path'
  UNION SELECT name, name || e FROM r, ext WHERE ref_field = 'to_path'
  UNION SELECT name, name || '/index' || e FROM r, ext WHERE ref_field = 'to_path'
  UNION SELECT name, name || '/__init__' || e FROM r, ext WHERE ref_field = 'to_path'
  UNION SELECT name, regexp_replace(name, '\\.(js|jsx|mjs|cjs)$', '') || e FROM r, ext WHERE ref_field = 'to_path' AND regexp_matches(name, '\\.(js|jsx|mjs|cjs)$')),
live AS (
  SELECT r.ref_table, r.ref_key, r.ref_field FROM r JOIN f ON r.repo = f.repo AND r.name = f.path WHERE ref_field = 'from_path' AND came <= arrived AND (gone IS NULL OR gone > arrived)
  UNION SELECT r.ref_table, r.ref_key, r.ref_field FROM r JOIN names n ON r.name = n.name JOIN f ON r.repo = f.repo AND n.path = f.path WHERE ref_field = 'to_path' AND came <= arrived AND (gone IS NULL OR gone > arrived)
  UNION SELECT r.ref_table, r.ref_key, r.ref_field FROM r JOIN t ON r.repo = t.repo AND r.name = t.id WHERE ref_field = 'parent_id' AND came <= arrived AND (gone IS NULL OR gone > arrived)),
cases AS (SELECT ref_table, ref_key, ref_field, arrived FROM r ANTI JOIN live USING (ref_table, ref_key, ref_field))
"""

_OPEN = _CASES + """,
ev AS (SELECT 'imports' AS ref_table, 'from_path' AS ref_field, repo, path AS name, came AS moment, 1 AS d FROM f WHERE gone IS NULL OR gone > came
  UNION ALL SELECT 'imports', 'from_path', repo, path, gone, -1 FROM f WHERE gone > came
  UNION ALL SELECT 'symbols', 'parent_id', repo, id, came, 1 FROM t WHERE gone IS NULL OR gone > came
  UNION ALL SELECT 'symbols', 'parent_id', repo, id, gone, -1 FROM t WHERE gone > came
  UNION ALL SELECT DISTINCT 'imports', 'to_path', n.repo, n.name, x.moment, x.d * x.k FROM (SELECT r.repo, n.name, n.path FROM names n JOIN (SELECT DISTINCT repo, name FROM r WHERE ref_field = 'to_path') r ON r.name = n.name) n
    JOIN (SELECT repo, path, came AS moment, 1 AS d, count(*) AS k FROM f WHERE gone IS NULL OR gone > came GROUP BY ALL UNION ALL SELECT repo, path, gone, -1, count(*) FROM f WHERE gone > came GROUP BY ALL) x ON n.repo = x.repo AND n.path = x.path),
ends AS (SELECT DISTINCT date_trunc('{p}', moment AT TIME ZONE 'UTC') AS p FROM (SELECT arrived AS moment FROM r UNION ALL SELECT moment FROM ev)),
keys AS (SELECT DISTINCT ref_table, ref_field, repo, name FROM r),
live_at AS (SELECT k.ref_table, k.ref_field, k.repo, k.name, p, coalesce(sum(d) FILTER (date_trunc('{p}', moment AT TIME ZONE 'UTC') <= p), 0) AS n FROM keys k CROSS JOIN ends
  LEFT JOIN ev ON ev.ref_table = k.ref_table AND ev.ref_field = k.ref_field AND ev.repo = k.repo AND ev.name = k.name GROUP BY ALL),
seen AS (SELECT r.ref_table, r.ref_field, r.repo, r.name, p, count(*) FILTER (date_trunc('{p}', arrived AT TIME ZONE 'UTC') <= p) AS refs FROM r CROSS JOIN ends GROUP BY ALL)
SELECT ref_table, ref_field, strftime(p, '%Y-%m') AS {name}, sum(CASE WHEN n <= 0 THEN refs ELSE 0 END)::BIGINT AS waiting FROM seen JOIN live_at USING (ref_table, ref_field, repo, name, p) GROUP BY ref_table, ref_field, p HAVING sum(refs) > 0"""

QUERIES = {"p4_found": p4_found, "p4_rates": p4_rates, "p4_replayed": p4_replayed, "p4_waiting": p4_waiting, "p4_snapshots": p4_snapshots}
_RATES = _CASES + """SELECT ref_table, ref_field, strftime(arrived AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_refs,
  count(*) FILTER ((ref_table, ref_key, ref_field) IN (SELECT (ref_table, ref_key, ref_field) FROM cases)) AS n_orphans FROM r GROUP BY ALL"""
SQL = {
    "p4_found": _CASES + "SELECT ref_table, ref_key, ref_field FROM cases",
    "p4_rates": _RATES,
    "p4_replayed": _RATES,
    "p4_snapshots": _OPEN.replace("{p}", "quarter").replace("{name}", "quarter"),
    "p4_waiting": _OPEN.replace("{p}", "month").replace("{name}", "month"),
}
