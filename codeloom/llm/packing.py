"""Problem 6: filling containers of fixed capacity with texts.

One pass counts tokens; everything after it works on (doc_id, tokens). Texts longer than the capacity are cut into full
pieces and a rest. The global histogram of piece lengths, which has at most capacity entries whatever the corpus, goes to
the driver: dynamic programming chooses the length buckets of least padding, and token-budget batches are planned bucket
by bucket from the longest, as patterns with a count. A batch takes the longest lengths of its own bucket that still fit;
batches that this fills to the last token stay, and the pieces of all others are combined across buckets in a second
step, again the longest that fit. Pieces find their container from their rank among the pieces of equal length: ranks
come from salted windows plus offsets, so that a length that a third of all texts share is never one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.llm.tokens import VOCABULARY, n_tokens
from codeloom.session import cut

BUCKETS = 16
#: Most containers that the buckets may cost, as a share of those without buckets; beyond it there are none.
MORE = 0.01
#: Pieces of one length that one task ranks.
RANK_ROWS = 50_000


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, k: int = BUCKETS) -> list[int]:
    """Upper bounds of at most k buckets with the least padding if every length is padded to its bucket's bound.

    lengths are distinct and ascending. Exact dynamic program; the cost of a bucket is Monge, so each row's best cuts
    are monotone and are found by divide and conquer.
    """
    n = len(lengths)
    if n == 0:
        return []
    c = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    t = np.concatenate([[0], np.cumsum(counts * lengths, dtype=np.float64)])
    cost = lambda i, j: lengths[j - 1] * (c[j] - c[i]) - (t[j] - t[i])  # noqa: E731  pieces i..j-1
    best = np.array([0.0, *(cost(0, j) for j in range(1, n + 1))])
    cuts = []
    for _ in range(min(k, n) - 1):
        row, at = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        row[0] = 0
        todo = [(1, n, 0, n)]
        while todo:
            low, high, a, b = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            if len(i) == 0:
                i = np.array([min(a, j - 1)])
            x = best[i] + lengths[j - 1] * (c[j] - c[i]) - (t[j] - t[i])
            m = int(x.argmin())
            row[j], at[j] = x[m], i[m]
            todo += [(low, j - 1, a, int(i[m])), (j + 1, high, int(i[m]), b)]
        cuts.append(at)
        best = row
    bounds, j = [], n
    for at in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(at[j])
    if j:
        bounds.append(int(lengths[j - 1]))
    return sorted(set(bounds))


@dataclass
class Plan:
    """Containers by rank: pieces of one length with ranks from start on lie in containers from container on, per of
    them in each. Sorted by (length, start)."""

    length: np.ndarray
    start: np.ndarray
    container: np.ndarray
    per: np.ndarray
    n_containers: int


def _batches(left: dict[int, int], capacity: int):
    """(pattern, repeat, free) of token-budget batches, each of the longest remaining lengths that fit; empties left.
    Each pattern is repeated until one of its lengths is used up, so there are no more patterns than distinct lengths."""
    order = sorted(left)
    while order:
        pattern: dict[int, int] = {}
        free, hi = capacity, len(order)
        while hi > 0:
            hi = int(np.searchsorted(order[:hi], free, side="right"))
            if hi == 0:
                break
            x = order[hi - 1]
            m = min(free // x, left[x])
            pattern[x] = m
            free -= m * x
            hi -= 1
        repeat = min(left[x] // m for x, m in pattern.items())
        for x, m in pattern.items():
            left[x] -= m * repeat
            if left[x] == 0:
                order.pop(int(np.searchsorted(order, x)))
        yield pattern, repeat, free


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, bounds: list[int]) -> Plan:
    """Batches of each bucket's own lengths, from the longest bucket; then the left-over partial batches combined across
    buckets."""
    left = {int(x): int(n) for x, n in zip(lengths, counts, strict=True) if n > 0 and x > 0}
    used = dict.fromkeys(left, 0)
    rows, containers = [], 0

    def close(pattern: dict[int, int], repeat: int) -> None:
        nonlocal containers
        for x, m in pattern.items():
            rows.append((x, used[x], containers, m))
            used[x] += m * repeat
        containers += repeat

    partial: dict[int, int] = {}
    lows = [0, *bounds][: len(bounds)]
    for low, high in sorted(zip(lows, bounds, strict=True), reverse=True):
        for pattern, repeat, free in _batches({x: n for x, n in left.items() if low < x <= high}, capacity):
            if free == 0:
                close(pattern, repeat)
            else:
                for x, m in pattern.items():
                    partial[x] = partial.get(x, 0) + m * repeat
    for pattern, repeat, _ in _batches(partial, capacity):
        close(pattern, repeat)
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(a[:, 0], a[:, 1], a[:, 2], a[:, 3], containers)


def best_plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, k: int = BUCKETS) -> Plan:
    """The plan with at most k buckets, or, where that needs more than MORE of the containers of one bucket, the latter:
    short pieces bound in batches of their own can be the only ones that fit beside long ones."""
    bounds = bucket_bounds(lengths, counts, k)
    dealt, one = plan(lengths, counts, capacity, bounds), plan(lengths, counts, capacity, bounds[-1:])
    return dealt if dealt.n_containers <= one.n_containers + max(1, int(MORE * one.n_containers)) else one


def pieces(documents: DataFrame, specs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(spec_id, capacity, doc_id, piece, start_token, n_tokens): whole texts, or full pieces and a rest of those longer
    than the capacity. Texts without tokens are one piece of 0."""
    # Token counts are written once: the histogram and the assignment both need them.
    sizes = cut(documents.where("doc_id is not null").select("doc_id", n_tokens(F.col("text"), path).alias("n")))
    specs = specs.where("spec_id is not null and capacity > 0").select(F.col("spec_id").cast("long"), F.col("capacity").cast("long")).distinct().collect()  # a configuration of a few rows
    wanted = F.array(*[F.struct(F.lit(s).alias("spec_id"), F.lit(c).alias("capacity")) for s, c in sorted(map(tuple, specs))])
    each = sizes.select("*", F.explode(wanted if specs else F.expr("cast(array() as array<struct<spec_id:bigint,capacity:bigint>>)")).alias("s")).select("doc_id", "n", "s.*")
    each = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("capacity")) - 1))))
    start = F.col("piece") * F.col("capacity")
    return each.select("spec_id", "capacity", "doc_id", "piece", start.alias("start_token"), F.least(F.col("capacity"), F.col("n") - start).alias("n_tokens"))


def pack(documents: DataFrame, specs: DataFrame, path: str = VOCABULARY, k: int = BUCKETS) -> DataFrame:
    """(spec_id, container_id, doc_id, piece, start_token, n_tokens) with every text in containers of every capacity.

    The tokens of a container never exceed its capacity and a text is divided only if it is longer than that. Pieces of
    0 tokens lie in container 0. Rows with null doc_id, spec_id or without a positive capacity are left out; empty
    tables give no rows. Repeated rows of a document are packed as often as they occur.
    """
    rows = pieces(documents, specs, path)
    histogram = rows.groupBy("spec_id", "capacity", "n_tokens").agg(F.count("*").alias("n")).toPandas()  # at most capacity rows a spec
    plans = {}
    for (spec, capacity), h in histogram.groupby(["spec_id", "capacity"]):
        h = h[h["n_tokens"] > 0].sort_values("n_tokens")
        lengths, counts = h["n_tokens"].to_numpy(np.int64), h["n"].to_numpy(np.int64)
        plans[int(spec)] = best_plan(lengths, counts, int(capacity), k)
    salts = int(max([1, *(histogram["n"] // RANK_ROWS + 1)])) if len(histogram) else 1
    key = ["spec_id", "n_tokens", "salt"]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    if salts == 1:
        rank = rows.withColumn("before", F.lit(0).cast("long"))
    else:
        by_length = W.partitionBy("spec_id", "n_tokens").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
        offsets = rows.groupBy(*key).agg(F.count("*").alias("n")).select(*key, F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("before"))
        rank = rows.join(offsets, key)
    rank = rank.withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy(*key).orderBy("doc_id", "piece")) - 1)
    shared = documents.sparkSession.sparkContext.broadcast(plans)  # bounded by the capacities, not by the corpus

    def place(batches):
        for pdf in batches:
            container = np.zeros(len(pdf), np.int64)
            for spec, at in pdf.groupby("spec_id").indices.items():
                p = shared.value[int(spec)]
                length, r = pdf["n_tokens"].to_numpy()[at], pdf["rank"].to_numpy()[at]
                some = length > 0
                if some.any():
                    n = int(max(p.start.max(), r.max())) + 1
                    i = np.searchsorted(p.length * n + p.start, length[some] * n + r[some], side="right") - 1
                    container[at[some]] = p.container[i] + (r[some] - p.start[i]) // p.per[i]
            yield pd.DataFrame({"spec_id": pdf["spec_id"], "container_id": container, **{c: pdf[c] for c in ("doc_id", "piece", "start_token", "n_tokens")}})

    return rank.mapInPandas(place, "spec_id long, container_id long, doc_id long, piece long, start_token long, n_tokens long")


def buckets(documents: DataFrame, specs: DataFrame, path: str = VOCABULARY, k: int = BUCKETS) -> DataFrame:
    """(spec_id, bucket, longest, n_pieces, n_tokens, padding): the chosen length buckets and what padding to their
    bounds would cost."""
    rows = pieces(documents, specs, path).where("n_tokens > 0")
    histogram = rows.groupBy("spec_id", "n_tokens").agg(F.count("*").alias("n"))
    local = histogram.toPandas()
    bounds = [(int(s), i, int(b)) for s, h in local.sort_values("n_tokens").groupby("spec_id") for i, b in enumerate(bucket_bounds(h["n_tokens"].to_numpy(np.int64), h["n"].to_numpy(np.int64), k))]
    spark = documents.sparkSession
    b = spark.createDataFrame(bounds, "spec_id long, bucket int, longest long")
    w = W.partitionBy("spec_id").orderBy("bucket")
    b = b.withColumn("above", F.coalesce(F.lag("longest").over(w), F.lit(0)))
    joined = histogram.alias("h").join(F.broadcast(b).alias("b"), F.expr("h.spec_id = b.spec_id and h.n_tokens > b.above and h.n_tokens <= b.longest"))
    return joined.groupBy("b.spec_id", "b.bucket", "b.longest").agg(
        F.sum("h.n").alias("n_pieces"), F.sum(F.expr("h.n * h.n_tokens")).alias("n_tokens"), F.sum(F.expr("h.n * (b.longest - h.n_tokens)")).alias("padding")
    )
