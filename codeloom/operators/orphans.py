"""References whose target was not there: keyed pending state over arrivals and deletions, kept batch by batch (maintained),
or replayed over all data at once (orphans, open_orphans).

Every event belongs to a key (repo, name). A parent's arrival adds one live target to each name it answers to, its
deletion takes it away again; a reference probes its name at its own arrival. The state of a key is the number of its
live targets. It is carried from period to period and replayed inside a period only where targets changed in it, so
that neither a hot key nor a bulk load is ever one task: deltas are summed per (key, period) before any shuffle of
single events, and the references of a busy (key, period) are salted against a copy of its few or many target changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.paths import blank, import_names, normal_path
from codeloom.session import cut

KEY = ["domain", "repo", "name"]
#: Field of the references of each domain of names.
FIELDS = {"path": ("imports", "from_path"), "import": ("imports", "to_path"), "symbol": ("symbols", "parent_id")}
#: References of one key and period that one task replays before they are salted.
SALT_ROWS = 50_000


def first_rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key: the values of its first delivery (smallest ingested_at; among equals the smallest values).

    Rows without key or ingested_at are dropped. Other columns of the table are ignored, whatever their names.
    """
    rows = df.select(F.col(key), F.struct("ingested_at", *columns).alias("r")).where(F.col(key).isNotNull() & F.col("r.ingested_at").isNotNull())
    return rows.groupBy(key).agg(F.min("r").alias("r")).select(key, "r.*")


def _deltas(domain: str, df: DataFrame, key: str, names: Column) -> DataFrame:
    """+1 at a target's first arrival and -1 at its deletion, for every name; targets deleted on arrival never live."""
    rows = df.select(key, "repo", names.alias("names"), "ingested_at", "deleted_at").where(F.col(key).isNotNull() & F.col("ingested_at").isNotNull())
    lives = rows.groupBy(key).agg(F.min(F.struct("ingested_at", "repo", "names")).alias("r"), F.max("deleted_at").alias("gone"))
    lives = lives.where(F.col("gone").isNull() | (F.col("gone") > F.col("r.ingested_at")))
    changes = F.filter(
        F.array(F.struct(F.col("r.ingested_at").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("gone").alias("at"), F.lit(-1).alias("delta"))),
        lambda x: x["at"].isNotNull(),
    )
    named = lives.select("r.repo", F.explode("r.names").alias("name"), changes.alias("c"))
    return named.select(F.lit(domain).alias("domain"), "repo", "name", F.explode("c").alias("c")).select("domain", "repo", "name", "c.at", "c.delta")


def references(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(domain, repo, name, at, ref_table, ref_key, ref_field): every non-blank reference at its first delivery."""
    i = first_rows(imports, "edge_key", ["repo", "from_path", "to_path", "is_relative"])
    both = F.array(
        F.struct(F.lit("from_path").alias("f"), F.lit("path").alias("domain"), F.col("from_path").alias("v")),
        F.struct(F.lit("to_path").alias("f"), F.lit("import").alias("domain"), F.when(F.col("is_relative"), F.col("to_path")).alias("v")),
    )
    edges = i.select("edge_key", "repo", "ingested_at", F.explode(both).alias("x")).where(~blank(F.col("x.v")))
    edges = edges.select("x.domain", "repo", normal_path(F.col("x.v")).alias("name"), F.col("ingested_at").alias("at"), F.lit("imports").alias("ref_table"), F.col("edge_key").cast("long").alias("ref_key"), F.col("x.f").alias("ref_field"))
    s = first_rows(symbols, "symbol_key", ["repo", "parent_id"]).where(~blank(F.col("parent_id")))
    parents = s.select(F.lit("symbol").alias("domain"), "repo", F.col("parent_id").alias("name"), F.col("ingested_at").alias("at"), F.lit("symbols").alias("ref_table"), F.col("symbol_key").cast("long").alias("ref_key"), F.lit("parent_id").alias("ref_field"))
    return edges.unionByName(parents)


def targets(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(domain, repo, name, at, delta): arrivals and deletions of files, by path and by import name, and of symbols."""
    path = normal_path(F.col("repo_path"))
    return (
        _deltas("path", files, "file_id", F.array(path))
        .unionByName(_deltas("import", files, "file_id", import_names(path)))
        .unionByName(_deltas("symbol", symbols, "symbol_key", F.array("id")))
        .where(F.col("name").isNotNull())
    )


def carried(refs: DataFrame, changes: DataFrame, period: str) -> DataFrame:
    """State per key and period: live targets before it (before), change in it (change), number of references in it
    (n_refs) and of target changes (n_changes), and how many salts its references get."""
    a = refs.groupBy(*KEY, F.date_trunc(period, "at").alias("period")).agg(F.count("*").alias("n_refs"))
    b = changes.groupBy(*KEY, F.date_trunc(period, "at").alias("period")).agg(F.sum("delta").alias("change"), F.count("*").alias("n_changes"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    rows = a.unionByName(b, allowMissingColumns=True).groupBy(*KEY, "period").agg(zero("n_refs"), zero("change"), zero("n_changes"))
    w = W.partitionBy(*KEY).orderBy("period").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("change").over(w), F.lit(0))).withColumn("salts", F.ceil((F.col("n_refs") + 1) / SALT_ROWS).cast("int"))


def by_moment(changes: DataFrame) -> DataFrame:
    """One row per key and moment, so that targets loaded together reach each salt of a busy period as one row."""
    return changes.groupBy(*KEY, "at").agg(F.sum("delta").alias("delta"))


def orphans(refs: DataFrame, changes: DataFrame, period: str = "day") -> DataFrame:
    """References without a live target at their own arrival, as (ref_table, ref_key, ref_field, repo, name, at).

    A null repo equals a null repo. A target that arrives or is deleted at the very moment of the reference counts as
    arrived or deleted. Empty inputs give no rows.
    """
    state = carried(refs, changes, period).where("n_refs > 0").select(*KEY, "period", "before", "n_changes", "salts")
    on = lambda x, y: [F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in [*KEY, "period"]]
    r = refs.withColumn("period", F.date_trunc(period, "at")).alias("r")
    r = r.join(state.alias("s"), on("r", "s")).select("r.*", "s.before", "s.n_changes", F.pmod(F.xxhash64("ref_table", "ref_field", "ref_key"), F.col("s.salts")).cast("int").alias("salt"))
    quiet = r.where("n_changes = 0").where("before <= 0")
    busy = r.where("n_changes > 0").select(*KEY, "period", "salt", "at", "before", F.lit(0).alias("delta"), "ref_table", "ref_key", "ref_field")
    c = by_moment(changes).withColumn("period", F.date_trunc(period, "at")).alias("c")
    c = c.join(state.where("n_changes > 0").alias("s"), on("c", "s")).select("c.*", F.explode(F.sequence(F.lit(0), F.col("s.salts") - 1)).alias("salt"))
    # Target changes come before the references of the same moment.
    w = W.partitionBy(*KEY, "period", "salt").orderBy("at", F.col("ref_table").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    replayed = busy.unionByName(c, allowMissingColumns=True).withColumn("live", F.sum("delta").over(w)).where("ref_table is not null and before + live <= 0")
    out = ["ref_table", "ref_key", "ref_field", "repo", "name", "at"]
    return quiet.select(*out).unionByName(replayed.select(*out))


def open_orphans(refs: DataFrame, changes: DataFrame, period: str = "month") -> DataFrame:
    """Snapshots at each period's end: references that arrived so far and whose name has no live target then.

    Arriving parents resolve all waiting references of their name and deletions reopen them, so a period's snapshot may
    be lower than the one before. (ref_table, ref_field, period, waiting); periods without any event are left out.
    """
    at = F.date_trunc(period, "at").alias("period")
    r = refs.groupBy(*KEY, "ref_table", "ref_field", at).agg(F.count("*").alias("n_refs"))
    c = changes.groupBy(*KEY, at).agg(F.sum("delta").cast("long").alias("change"))
    named = F.create_map(*[F.lit(x) for d, (t, f) in FIELDS.items() for x in (d, f)])
    tables = F.create_map(*[F.lit(x) for d, (t, f) in FIELDS.items() for x in (d, t)])
    c = c.withColumns({"ref_table": tables[F.col("domain")], "ref_field": named[F.col("domain")]})
    events = r.unionByName(c, allowMissingColumns=True).groupBy(*KEY, "ref_table", "ref_field", "period").agg(
        F.coalesce(F.sum("n_refs"), F.lit(0)).alias("n_refs"), F.coalesce(F.sum("change"), F.lit(0)).alias("change")
    )
    # Waiting references of a key change only in periods with events of the key: their differences add up over all keys.
    w = W.partitionBy(*KEY).orderBy("period")
    events = events.withColumns({"refs": F.sum("n_refs").over(w), "live": F.sum("change").over(w)})
    events = events.withColumn("now", F.when(F.col("live") <= 0, F.col("refs")).otherwise(0))
    steps = events.withColumn("step", F.col("now") - F.coalesce(F.lag("now").over(w), F.lit(0)))
    months = steps.groupBy("ref_table", "ref_field", "period").agg(F.sum("step").alias("step"))
    return months.select("ref_table", "ref_field", "period", F.sum("step").over(W.partitionBy("ref_table", "ref_field").orderBy("period")).alias("waiting"))


def keyed(df: DataFrame) -> DataFrame:
    """df with its names as one 16-byte key (a null repo is a repo of its own), which is all that a shuffle of the state
    carries of them."""
    name = F.concat(F.col("domain"), F.lit("\0"), F.coalesce(F.concat(F.lit("r"), "repo"), F.lit("")), F.lit("\0"), "name")
    return df.withColumn("key", F.unhex(F.md5(name)))


def empty_state(spark: SparkSession) -> DataFrame:
    """The pending state before any event: key, domain, live targets of the key, references to it so far."""
    return spark.createDataFrame([], "key binary, domain string, live long, refs long")


def step(state: DataFrame, refs: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One batch of events over the state: (the state after it, the references of the batch without a live target).

    refs and changes are keyed and later than all that the state has seen. References probe the live targets of their key
    at their own moment; arriving targets resolve the references that wait for them and deletions reopen them, both by the
    count of live targets of the key. Keys without events keep their row as it is. Only references of keys whose targets
    change within the batch are replayed, salted where they are many.
    """
    a = refs.groupBy("key", "domain").agg(F.count("*").alias("n_refs"))
    b = changes.groupBy("key", "domain").agg(F.sum("delta").alias("change"), F.count("*").alias("n_changes"))
    old = state.select("key", "domain", "live", "refs")
    each = old.unionByName(a, allowMissingColumns=True).unionByName(b, allowMissingColumns=True)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    merged = cut(each.groupBy("key", "domain").agg(*[total(c) for c in ("live", "refs", "n_refs", "change", "n_changes")]))
    after = merged.select("key", "domain", (F.col("live") + F.col("change")).alias("live"), (F.col("refs") + F.col("n_refs")).alias("refs"))
    now = merged.where("n_refs > 0 AND (live <= 0 OR n_changes > 0)").select("key", "live", "n_changes", F.ceil((F.col("n_refs") + 1) / SALT_ROWS).cast("int").alias("salts"))
    out = ["ref_table", "ref_key", "ref_field", "repo", "name", "at"]
    met = refs.join(now, "key")
    quiet = met.where("n_changes = 0").select(*out)
    salt = F.pmod(F.xxhash64("ref_table", "ref_field", "ref_key"), F.col("salts")).cast("int").alias("salt")
    busy = met.where("n_changes > 0").select("key", salt, "live", F.lit(0).cast("long").alias("delta"), *out)
    moved = changes.groupBy("key", "at").agg(F.sum("delta").cast("long").alias("delta")).join(now.where("n_changes > 0"), "key")
    moved = moved.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "delta", "at")
    # Target changes come before the references of the same moment.
    w = W.partitionBy("key", "salt").orderBy("at", F.col("ref_table").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    replayed = busy.unionByName(moved, allowMissingColumns=True).withColumn("moved", F.sum("delta").over(w)).where("ref_table IS NOT NULL AND live + moved <= 0")
    return after, quiet.unionByName(replayed.select(*out))


def snapshot(state: DataFrame) -> DataFrame:
    """(ref_table, ref_field, waiting): references seen so far whose key has no live target now."""
    n = state.where("refs > 0").groupBy("domain").agg(F.sum(F.when(F.col("live") <= 0, F.col("refs")).otherwise(0)).alias("waiting"))
    named = F.create_map(*[F.lit(x) for d, (t, f) in FIELDS.items() for x in (d, F.struct(F.lit(t).alias("t"), F.lit(f).alias("f")))])
    return n.select(named[F.col("domain")]["t"].alias("ref_table"), named[F.col("domain")]["f"].alias("ref_field"), "waiting")


def maintained(refs: DataFrame, changes: DataFrame, period: str = "quarter") -> tuple[DataFrame, list[tuple[object, DataFrame]]]:
    """All events in batches of one period each through step: (the references without a target at their own arrival,
    [(period, snapshot at its end)]).

    The events are keyed and written once, by period; the state of every batch is written to the shared folder before the
    next, so a lost executor costs at most its part of one batch. Empty inputs give no rows and no snapshots.
    """
    spark = refs.sparkSession
    r = cut(keyed(refs).withColumn("period", F.date_trunc(period, "at")))
    c = cut(keyed(changes).groupBy("key", "domain", "at").agg(F.sum("delta").cast("long").alias("delta")).withColumn("period", F.date_trunc(period, "at")))
    periods = sorted(x.period for x in r.select("period").union(c.select("period")).distinct().collect())  # a few per year
    state = empty_state(spark)
    found, snapshots = [], []
    for p in periods:
        state, orphan = step(state, r.where(F.col("period") == F.lit(p)), c.where(F.col("period") == F.lit(p)))
        found.append(orphan)
        snapshots.append((p, snapshot(state)))
    none = r.select("ref_table", "ref_key", "ref_field", "repo", "name", "at").limit(0)
    out = found[0] if found else none
    for more in found[1:]:
        out = out.unionByName(more)
    return out, snapshots
