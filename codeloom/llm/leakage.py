"""Problem 7: evaluation texts leaking into training text, by winnowing.

Texts become words (runs of letters and digits, case ignored, HTML markup and entities undone). Of every two adjacent
hashes of K words the smaller is kept, so that any K + 1 words shared without a difference share a kept hash. Among 20
words of which two differ, one run has at least six words: with K = 5 no such passage can be missed. Kept hashes of
corpus and items meet in a join; every pair that shares one is extended along its diagonals and judged exactly.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut, small

K = 5
LEAST = 20
ONE_IN = 8
#: Rows of item fingerprints up to which they are broadcast; beyond, the join is a shuffle.
BROADCAST_ROWS = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*+>")


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits; tags of HTML are no words and entities stand for their characters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.lower())


def _winnow(h: np.ndarray) -> np.ndarray:
    """Positions of the smaller of every two adjacent hashes (the right one of equals); the only one if there is one."""
    if len(h) < 2:
        return np.arange(len(h))
    keep = np.zeros(len(h), bool)
    left = h[:-1] < h[1:]
    keep[:-1] |= left
    keep[1:] |= ~left
    return np.flatnonzero(keep)


def fingerprints(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, hash, position of its first word) of all kept hashes."""
    flat = [w for t in texts for w in t]
    if not flat:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
    codes, unique = pd.factorize(np.array(flat, dtype=object))
    each = pd.util.hash_array(np.asarray(unique, dtype=object), categorize=False)[codes]
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(each) - K + 1), np.uint64)
        for j in range(K):
            h = h * np.uint64(0x9E3779B97F4A7C15) + each[j : len(each) - K + 1 + j]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    out, at = [], 0
    for i, t in enumerate(texts):
        own = h[at : at + max(0, len(t) - K + 1)]
        p = _winnow(own)
        out.append((np.full(len(p), i, np.int64), own[p].view(np.int64), p.astype(np.int32)))
        at += len(t)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def fingerprint_rows(texts: DataFrame, key: str) -> DataFrame:
    """(key, fp, pos) of all kept hashes of the text column; null texts give no rows."""

    def run(batches):
        for pdf in batches:
            i, h, p = fingerprints([words(t) for t in pdf["text"]])
            yield pd.DataFrame({key: pdf[key].to_numpy()[i], "fp": h, "pos": p})

    return texts.where(F.col("text").isNotNull() & F.col(key).isNotNull()).select(key, "text").mapInPandas(run, f"{key} long, fp long, pos int")


def without_instruction(items: DataFrame) -> DataFrame:
    """(item_id, words): the items' words without the instruction that items of their suite share.

    Items of one suite that begin with the same six words, three of them or more, share an instruction: it is their
    longest common beginning, which is that of the first and last of them in order.
    """

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"item_id": pdf["item_id"], "suite": pdf["suite"], "words": [words(t) for t in pdf["text"]]})

    w = items.where(F.col("text").isNotNull()).select("item_id", "suite", "text").mapInPandas(run, "item_id long, suite string, words array<string>")
    w = w.withColumn("head", F.slice("words", 1, 6))
    groups = w.where(F.size("words") >= 6).groupBy("suite", "head").agg(F.countDistinct("item_id").alias("n"), F.min("words").alias("a"), F.max("words").alias("b"))
    same = F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y))
    groups = groups.where("n >= 3").select("suite", "head", (F.array_position(same, False) - 1).alias("shared"))
    joined = w.alias("w").join(groups.alias("g"), F.col("w.suite").eqNullSafe(F.col("g.suite")) & (F.col("w.head") == F.col("g.head")), "left")
    rest = F.expr("slice(w.words, coalesce(int(g.shared), 0) + 1, size(w.words))")
    return joined.select("w.item_id", rest.alias("words")).dropDuplicates()


def shared_words(doc: np.ndarray, item: np.ndarray, diagonals: list[int], least: int = LEAST, one_in: int = ONE_IN, slack: int = 3) -> bool:
    """Whether the document holds at least so many consecutive words of the item, one in so many missing, replaced or
    with others in between. Both are arrays of word numbers, diagonals the differences of positions of shared hashes."""
    n = len(item)
    if n < least:
        return False
    todo = sorted(set(diagonals))
    clusters, at = [], 0
    for k in range(1, len(todo) + 1):
        if k == len(todo) or todo[k] - todo[k - 1] > 2 * slack:
            clusters.append((todo[at] - slack, todo[k - 1] + slack))
            at = k
    for low, high in clusters:
        band = np.arange(low, high + 1)
        where = np.arange(n)[None, :] + band[:, None]
        inside = (where >= 0) & (where < len(doc))
        eq = inside & (doc[np.clip(where, 0, len(doc) - 1)] == item[None, :])
        anywhere = np.concatenate([[0], np.cumsum(eq.any(0))])
        if (anywhere[least:] - anywhere[:-least]).max() < least - least // one_in - 1:
            continue
        # Best path through the band: a word of the item is met on a diagonal or is an error; changing the diagonal by
        # one costs an error. Errors weigh as much as one_in - 1 met words.
        bad = one_in - 1
        score = np.zeros(len(band))
        moves = np.abs(band[:, None] - band[None, :]) * bad
        back, gain = [], np.where(eq, 1, -bad)
        for i in range(n):
            reach = score[:, None] - moves
            came = reach.argmax(0)
            score = reach[came, np.arange(len(band))] + gain[:, i]
            fresh = score < 0
            came = np.where(fresh, -1, came)
            score = np.where(fresh, 0, score)
            back.append(came)
        # A passage is long enough if on some path that ends at i the running score has not fallen for so many words.
        k = int(score.argmax())
        best = np.zeros(n)
        for i in range(n - 1, -1, -1):
            j = back[i][k]
            if j < 0:
                best[i] = gain[k, i]
                k = int(eq[:, :i].sum(1).argmax()) if i else k
                continue
            best[i] = gain[k, i] - moves[j, k]
            k = int(j)
        sums = np.concatenate([[0], np.cumsum(best)])
        lowest = np.minimum.accumulate(sums)
        if (sums[least:] >= lowest[: n + 1 - least]).any():
            return True
        for e in eq:  # a plain diagonal may hold a passage off the best path
            sums = np.concatenate([[0], np.cumsum(np.where(e, 1, -bad))])
            if (sums[least:] >= np.minimum.accumulate(sums)[: n + 1 - least]).any():
                return True
    return False


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every document that holds a passage of an item.

    Documents and items without text give no rows, items shorter than LEAST words can't leak; a document or item that
    occurs twice counts once. Columns other than doc_id, text, item_id and suite are ignored.
    """
    tests = cut(without_instruction(items))

    def run(batches):
        for pdf in batches:
            i, h, p = fingerprints([list(x) for x in pdf["words"]])
            yield pd.DataFrame({"item_id": pdf["item_id"].to_numpy()[i], "fp": h, "ipos": p})

    known = cut(tests.mapInPandas(run, "item_id long, fp long, ipos int"))
    known = F.broadcast(known) if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else known
    hits = fingerprint_rows(documents, "doc_id").join(known, "fp")
    met = cut(hits.groupBy("doc_id", "item_id").agg(F.collect_set(F.col("pos") - F.col("ipos")).alias("diagonals")))
    pairs = met.join(tests, "item_id")
    by_doc = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "words", "diagonals")).alias("tests"))

    def judge(batches):
        for pdf in batches:
            out = []
            for doc, text, cases in zip(pdf["doc_id"], pdf["text"], pdf["tests"], strict=True):
                number: dict[str, int] = {}
                own = np.array([number.setdefault(w, len(number)) for w in words(text)], np.int64)
                for case in cases:
                    item = np.array([number.get(w, -1) for w in case["words"]], np.int64)
                    if shared_words(own, item, [int(x) for x in case["diagonals"]]):
                        out.append((doc, case["item_id"]))
            yield pd.DataFrame(out, columns=["doc_id", "item_id"]).astype("int64")

    # only the texts of documents with a hit move: their ids meet the texts where they lie, if they are few enough to send
    some = documents.select("doc_id", "text").where("text is not null").join(small(cut(met.select("doc_id").distinct()), 64), "doc_id", "left_semi")
    texts = some.join(by_doc, "doc_id")
    return texts.mapInPandas(judge, "doc_id long, item_id long").dropDuplicates()
