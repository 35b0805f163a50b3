"""Every core query against its SQL on the smallest tables."""

import duckdb
import pytest

from codeloom.plans import catalog, orphans, pages

SF = "/root/testdata/sf0.001"
TABLES = "documents events files imports index_state symbols".split()
SQL = {**orphans.SQL, **catalog.SQL, **pages.SQL}
QUERIES = {**orphans.QUERIES, **catalog.QUERIES, **pages.QUERIES}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(rows):
    return sorted(tuple(str(x.replace(tzinfo=None)) if hasattr(x, "tzinfo") else x for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    norm = lambda rows: sorted((tuple(str(x.replace(tzinfo=None)) if hasattr(x, "tzinfo") else x for x in r) for r in rows), key=key)
    assert norm(got) == norm(want)


def test_empty_tables(spark):
    empty = {t: spark.read.parquet(f"{SF}/{t}.parquet").limit(0) for t in TABLES}
    files, symbols, edges = catalog.c.live_files(empty["files"]), catalog.c.symbols_once(empty["symbols"]), catalog.c.edges_once(empty["imports"])
    for df in (catalog.c.dependents(edges), catalog.c.public_surface(symbols, files), catalog.c.state_diff(files, empty["index_state"]), catalog.c.entries(files, symbols)):
        assert df.count() == 0


@pytest.mark.parametrize("name", sorted(set(pages.QUERIES) - set(pages.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
