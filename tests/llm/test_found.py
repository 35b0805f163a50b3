"""The pN_found queries on the smallest tables, and their operators on empty and null input."""

import pytest
from pyspark.sql import functions as F

from codeloom.llm import abuse, secrets
from codeloom.llm.provenance import judged
from codeloom.llm.queries import QUERIES
from codeloom.llm.syntax import checked

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if q.endswith("_found")))
def test_found_has_distinct_rows(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(rows) == len(set(rows))


def _tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("files", "documents", "symbols", "doc_labels")}


def test_empty_and_null_input(spark):
    t = _tables(spark)
    none = {k: v.limit(0) for k, v in t.items()}
    nulls = t["documents"].withColumn("text", F.lit(None).cast("string"))
    assert judged(none["files"], none["documents"]).count() == 0
    assert judged(t["files"], nulls).count() == 0
    assert checked(t["files"], nulls).count() == 0
    assert secrets.located(nulls, none["symbols"]).count() == 0
    model = abuse.train(none["documents"], none["doc_labels"])
    assert {r.score for r in abuse.scored(nulls, model).collect()} == {-1.0}


def test_attribute_patterns(spark):
    import re

    from codeloom.functions.globs import glob_regex

    assert re.match(glob_regex("*.pb.go", ""), "a/b/x.pb.go")
    assert re.match(glob_regex("/gen/**", ""), "gen/a/b.py") and not re.match(glob_regex("/gen/**", ""), "x/gen/a.py")
    assert re.match(glob_regex("*.js", "web"), "web/a/b.js") and not re.match(glob_regex("*.js", "web"), "b.js")


def test_masking_keeps_the_code_around(spark):
    text = 'a = 1\ntoken = "ghp_' + "aB3d" * 9 + '"\nb = os.environ["X_TOKEN"]\n'
    docs = spark.createDataFrame([(1, text, "a.py")], "doc_id long, text string, repo_path string")
    syms = spark.createDataFrame([], "symbol_key long, signature string, docstring string, file string")
    found = spark.createDataFrame([("documents", 1, text.index("ghp_"), text.index('"\nb'))], "tbl string, row_key long, at int, until int")
    row = secrets.masked_documents(docs, found).collect()[0]
    assert len(row.text) == len(text) and "ghp_" not in row.text and compile(row.text, "a", "exec")
    assert secrets.extracted(docs, syms).where("line_no = 2").count() >= 1


def test_abuse_holds_out():
    bad = ["You are a worthless idiot, get out.", "Shut up you stupid moron.", "You pathetic idiot, nobody wants you."] * 6
    good = ["The lantern was late again.", "Please add a test for the kernel.", "Looks good, thanks for the rework."] * 12
    w = abuse.fit(bad + good, [1] * len(bad) + [0] * len(good))
    def s(t):
        return max(abuse.scores(abuse.passages(t), w))

    assert s("you stupid id1ot get out") > s("please add a page for the lantern")
    assert s("y0u worthlesss idi.ot, shut up moron") > 0 > s("Please add a test for the lantern.")
