"""Pages, exports and summaries without SQL, against plain Python over the smallest tables."""

from pyspark.sql import functions as F

from codeloom.functions.tokens import encoding
from codeloom.operators import catalog as c
from codeloom.operators import exports, pages

SF = "/root/testdata/sf0.001"


def _index(spark):
    t = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("files", "symbols", "imports")}
    return c.live_files(t["files"]), c.symbols_once(t["symbols"]), c.edges_once(t["imports"])


def test_worth_summary_equals_brute_force(spark):
    files, symbols, _ = _index(spark)
    got = {r.file_id: (r.n_symbols, r.most_complex, r.n_tokens) for r in c.worth_summary(symbols, files).collect()}
    rows = {}
    for s in symbols.orderBy("symbol_ord", "symbol_key").collect():
        rows.setdefault(s.file_id, []).append(s)
    want = {}
    for f in files.collect():
        mine = rows.get(f.file_id, [])
        if not f.language or not mine:
            continue
        text = (f.summary or "") + "\n" + "\n".join(s.signature or "" for s in mine)
        n, most = len(encoding().encode_ordinary(text)), max(s.complexity or 0 for s in mine)
        if all(not s.docstring for s in mine) or most > 15 or n > 800:
            want[f.file_id] = (len(mine), most, n)
    assert got == want and want


def test_front_matter_and_tokens_of_whole_pages(spark):
    files, symbols, edges = _index(spark)
    parts = pages.file_pages(files, symbols).unionByName(pages.module_pages(files, symbols, edges))
    bodies = {(r.repo, r.path): r.body for r in pages.whole(parts).collect()}
    sizes = {(r.repo, r.path): r.tokens for r in pages.page_tokens(parts).collect()}
    assert set(sizes) == set(bodies)
    for k, n in sizes.items():
        assert n == len(encoding().encode_ordinary(bodies[k]))
    texts = pages.whole(pages.with_front_matter(parts, "2024-01-01T00:00:00.000Z").drop("language").withColumn("language", F.lit(None).cast("string")))
    for r in texts.collect():
        head, _, body = r.body.partition("\n---\n")
        keys = [x.split(":")[0].strip() for x in head.split("\n")[1:]]
        assert keys[:8] == ["kind", "id", "title", "path", "tokens", "stale", "generatedAt", "generator"]
        assert keys[8:] == (["source", "repoPath", "language", "module"] if r.kind == "file" else [])
        assert body == bodies[r.repo, r.path] and f"tokens: {sizes[r.repo, r.path]}\n" in head + "\n"


def test_long_tables_keep_every_row_in_parts(spark):
    n = 3 * pages.PART_ROWS + 7
    files = spark.range(n).selectExpr("id AS file_id", "'r' AS repo", "concat('m/f', id, '.py') AS repo_path", "'m' AS module", "int(id) AS file_ord", "'a|b' AS summary", "'python' AS language", "1L AS size")
    symbols = spark.range(n).selectExpr("id AS symbol_key", "'r' AS repo", "0L AS file_id", "int(id) AS symbol_ord", "concat('s', id) AS name", "'function' AS kind", "'x\ny|z' AS signature", "1 AS line_start", "2 AS line_end", "'public' AS visibility", "concat('m/f0.py::function.s', id) AS id")
    edges = spark.createDataFrame([], "repo string, from_path string, to_path string, edge_ord int, edge_key long")
    one = pages.whole(pages.file_pages(files, symbols)).where("path = 'files/m/f0.py.md'").first().body
    assert [x.split(" | ")[0] for x in one.split("\n") if x.startswith("| s")] == [f"| s{i}" for i in range(n)]
    assert "`x y\\|z`" in one
    module = pages.whole(pages.module_pages(files, symbols, edges)).first().body
    assert sum(x.startswith("| [m/f") for x in module.split("\n")) == n and f"- _({n - 20} more)_" in module
    assert pages.module_pages(files, symbols, edges).where("kind = 'module'").count() == 5


def test_exports_and_empty_index(spark):
    files, symbols, edges = _index(spark)
    lines = exports.index_lines(files, symbols)
    assert lines.count() == files.count() + symbols.count() + files.where("module <> '_tests'").select("repo", "module").distinct().count()
    records = exports.meta(files, symbols, "t")
    assert records.count() == files.select("repo").distinct().count() and exports.valid(records).where("NOT valid").count() == 0
    broken = records.limit(1).withColumn("json", F.lit("{"))
    assert not exports.valid(broken).first().valid
    none = files.limit(0), symbols.limit(0), edges.limit(0)
    for df in (pages.symbol_pages(none[1]), pages.file_pages(*none[:2]), pages.module_pages(*none), pages.architecture_pages(*none), pages.index_pages(*none[:2]), pages.graph_summaries(none[1], none[2]), exports.index_lines(*none[:2]), exports.graph_lines(none[2]), c.worth_summary(none[1], none[0])):
        assert df.count() == 0
