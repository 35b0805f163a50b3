"""References without a target (problem 4)."""

from codeloom.operators.orphans import by_moment


def test_changes_of_one_moment_are_one_row(spark):
    rows = [("path", "r", "a.ts", f"2024-01-01 00:00:0{i // 3}", 1) for i in range(6)] + [("path", None, "a.ts", "2024-01-01 00:00:00", -1)] * 2
    changes = spark.createDataFrame(rows, "domain string, repo string, name string, at string, delta int").selectExpr("domain", "repo", "name", "cast(at as timestamp) at", "delta")
    got = sorted((r.repo or "", r.at.second, r.delta) for r in by_moment(changes).collect())
    assert got == [("", 0, -2), ("r", 0, 3), ("r", 1, 3)]


def _at(day):
    return f"2024-{day}"


def test_state_from_batch_to_batch(spark):
    from pyspark.sql import functions as F

    from codeloom.operators import orphans as o

    refs = [("path", "r", "a.ts", _at("01-05"), 1), ("path", "r", "a.ts", _at("04-10"), 2), ("path", "r", "a.ts", _at("07-02"), 3), ("path", "r", "a.ts", _at("07-20"), 4), ("path", None, "b.ts", _at("04-01"), 5), ("symbol", "r", "a.ts", _at("07-20"), 6)]
    changes = [("path", "r", "a.ts", _at("02-01"), 1), ("path", "r", "a.ts", _at("07-10"), -1), ("path", "r", "b.ts", _at("01-01"), 1), ("path", None, "b.ts", _at("04-01"), 1)]
    r = spark.createDataFrame(refs, "domain string, repo string, name string, at string, ref_key long").withColumn("at", F.to_timestamp("at")).withColumns({"ref_table": F.lit("t"), "ref_field": F.lit("f")})
    c = spark.createDataFrame(changes, "domain string, repo string, name string, at string, delta int").withColumn("at", F.to_timestamp("at"))
    found, snapshots = o.maintained(r, c)
    # 1 came before its target, 4 after the target was gone, 6 is of another domain; 5 came at the very moment of its target
    assert sorted(x.ref_key for x in found.collect()) == [1, 4, 6]
    assert sorted(x.ref_key for x in o.orphans(r, c).collect()) == [1, 4, 6]
    waiting = [{(x.ref_table, x.ref_field): x.waiting for x in s.collect()} for _, s in snapshots]
    # January's reference is resolved in February; the deletion in July reopens all references to the path
    assert waiting == [{("imports", "from_path"): 0}, {("imports", "from_path"): 0}, {("imports", "from_path"): 4, ("symbols", "parent_id"): 1}]
    state = o.empty_state(spark)
    after, orphan = o.step(state, o.keyed(r.where("ref_key = 1")), o.keyed(c.limit(0)))
    assert orphan.count() == 1 and [(x.live, x.refs) for x in after.collect()] == [(0, 1)]
    after, orphan = o.step(after, o.keyed(r.limit(0)), o.keyed(c.limit(1)))
    assert orphan.count() == 0 and [(x.live, x.refs) for x in after.collect()] == [(1, 1)]


def test_no_events(spark):
    from codeloom.operators import orphans as o

    r = spark.createDataFrame([], "domain string, repo string, name string, at timestamp, ref_table string, ref_key long, ref_field string")
    c = spark.createDataFrame([], "domain string, repo string, name string, at timestamp, delta int")
    found, snapshots = o.maintained(r, c)
    assert found.count() == 0 and snapshots == []
