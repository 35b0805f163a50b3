"""Problem 8: abusive, hateful or sexual content, by a subsequence string-kernel SVM with Nystrom landmarks.

The kernel counts common character subsequences of length four whose letters may have gaps (weight DECAY per skipped
letter), so an inserted, doubled or starred-out letter leaves most of the subsequences in place. A text is cut into
passages (sentences, windows of them where long); its score is that of its worst passage. Labels are of whole texts,
so training is multiple-instance: each abusive text contributes the passages that score worst.

Passages that clean texts hold are never dropped, so that a frequent harmless sentence outweighs the few wrong verdicts of
its texts; a fifth of the sample is held out of the fit and sets the threshold.

Only the fit sees the driver, on a bounded sample of labelled texts (SAMPLE); scoring runs in Arrow batches over all
texts. The fitted model is one vector of BUCKETS weights, whose size does not depend on the data.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import spread

#: Most labelled texts that the fit takes with verdict 0 and 1, by a hash of their id; each is read whole.
SAMPLE = (6000, 1500)
BUCKETS = 1 << 16
_MULTIPLIERS = (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)
LANDMARKS = 320
DECAY = 0.6
#: Words per window of a long sentence, and its step.
WINDOW, STEP = 10, 5
ROUNDS = 4
#: Clean passages of the first fit, and most that a round adds; cost of a text on the wrong side.
NEGATIVES = 6000
COST = 20.0

# Characters written for letters.
_LIKE = str.maketrans("абсԁеіјорѕтухһкмнαβεικνορτυχ", "abcdeijopstyxhkmhabeiknoptux")
_LEET = str.maketrans("013457@$!", "oleastasi")
# Skipped letters between the four letters of a subsequence.
_GAPS = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (0, 1, 1), (1, 0, 1)]
_SPLIT = re.compile(r"[.!?;]\s+|\n+|:(?<=\w:) (?=\S)")
_LETTER = r"a-z0-9@$!\u00df-\uffff"
_CODED = re.compile(rf"(?<![{_LETTER}])(?=[a-zß-￿]*+[0-9@$!])(?:(?=[0-9@$!]*[a-z])[{_LETTER}]*[0-9@$][{_LETTER}]*|[{_LETTER}]+![a-z][{_LETTER}]*)")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:\*+[^\W\d_]*)*|[\"'`][^\W\d_]|[\"'`]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?![^\W_])")


def normal(text: str) -> str:
    """Lower case, without accents, look-alike letters, zero-width characters and letters spaced out."""
    t = text.lower() if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text).casefold().translate(_LIKE))
    t = _SPACED.sub(lambda m: re.sub(r"[ .*_-]", "", m.group()), t)
    return _CODED.sub(_decoded, t)


def _decoded(m: re.Match) -> str:
    word = m.group()
    digits = sum(c.isdigit() for c in word)
    end = len(word.rstrip("!"))
    return word[:end].translate(_LEET) + word[end:] if len(word) <= 16 and 2 * digits <= len(word) and digits < len(word) else word


def _sentences(text: str) -> list[list[str]]:
    """Words of every sentence of the normal form, a single word only where it has four letters or more; quotes are kept as a mark."""
    out = []
    for part in _SPLIT.split(normal(text)):
        words = _TOKEN.findall(part)
        real = [w for w in words if w > "a"]
        if len(real) > 1 or real and len(real[0]) > 3:
            out.append(words)
    return out


def _starts(n: int) -> range:
    return range(0, max(1, n - WINDOW + STEP), STEP) if n > WINDOW else range(1)


def passages(text: str) -> list[str]:
    """Every sentence between spaces, in windows where it is long."""
    return list(dict.fromkeys(" " + " ".join(words[a : a + WINDOW]) + " " for words in _sentences(text) for a in _starts(len(words))))


def _grams(joined: str):
    """(weight, letters covered, bucket at each offset) of each pattern of gaps over a text."""
    code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    parts = [(code + np.uint32(1)) * np.uint32(k) for k in _MULTIPLIERS]
    parts = [(x ^ (x >> np.uint32(15))) * np.uint32(5**n) for n, x in enumerate(parts)]
    for a, b, c in _GAPS:
        at = (0, 1 + a, 2 + a + b, 3 + a + b + c)
        n = len(code) - at[3]
        if n > 0:
            h = parts[0][:n] + parts[1][at[1] : at[1] + n]
            h += parts[2][at[2] : at[2] + n]
            h += parts[3][at[3] :]
            h *= np.uint32(0x9E3779B1)
            h >>= np.uint32(16)
            yield DECAY ** (a + b + c), at[3] + 1, h


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of every gapped subsequence of each text, in order of rows; the squares of a row sum to 1."""
    row = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])
    rows, buckets, values = [], [], []
    for weight, span, bucket in _grams("".join(texts)):
        n = len(bucket)
        same = row[:n] == row[span - 1 :]
        rows.append(row[:n][same])
        buckets.append(bucket[same].astype(np.int64))
        values.append(np.full(len(rows[-1]), weight))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    r, k, v = np.concatenate(rows), np.concatenate(buckets), np.concatenate(values)
    order = np.argsort(r, kind="stable")
    r, k, v = r[order], k[order], v[order]
    norm = np.sqrt(np.bincount(r, v * v, len(texts)))
    return r, k, v / norm[r]


def _window_scores(joined: str, begin: np.ndarray, end: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Decision value of each window [begin, end) of joined: running sums of its subsequences, over their norm."""
    total, square = np.zeros(len(begin)), np.zeros(len(begin))
    for weight, span, bucket in _grams(joined):
        run = np.concatenate([[0.0], np.cumsum(weights[bucket])])
        last = np.maximum(end - span + 1, begin)
        total += weight * (run[last] - run[begin])
        square += weight * weight * (last - begin)
    return total / np.sqrt(np.maximum(square, 1e-9)) + weights[-1]


def scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Decision value of each passage; weights holds one number per bucket and the constant at its end."""
    end = np.cumsum([len(t) for t in texts], dtype=np.int64)
    begin = np.concatenate([[0], end[:-1]]).astype(np.int64) if len(texts) else end
    return _window_scores("".join(texts), begin, end, weights)


def text_scores(texts: list[str | None], weights: np.ndarray) -> list[float]:
    """Score of each whole text: that of its worst passage, -1 where it has none."""
    pieces: list[str] = []
    begin: list[int] = []
    end: list[int] = []
    counts: list[int] = []
    at = 0
    for text in texts:
        n = len(begin)
        for words in _sentences(text) if text else ():
            joined = " " + " ".join(words) + " "
            if len(words) <= WINDOW:
                begin.append(at)
                end.append(at + len(joined))
            else:
                edge = [at, *accumulate((len(w) + 1 for w in words), initial=at)][1:]  # the space before each word, and the last
                for a in _starts(len(words)):
                    begin.append(edge[a])
                    end.append(edge[min(a + WINDOW, len(words))] + 1)
            pieces.append(joined)
            at += len(joined)
        counts.append(len(begin) - n)
    if not begin:
        return [-1.0] * len(texts)
    values = _window_scores("".join(pieces), np.array(begin), np.array(end), weights)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    worst = np.maximum.reduceat(values, np.minimum(firsts[:-1], len(values) - 1))
    return [float(w) if n else -1.0 for w, n in zip(worst, counts, strict=True)]


class _Landmarks:
    """Nystrom features: whitened kernel values against the landmarks, which are kept by bucket."""

    def __init__(self, marks: list[str]):
        mark, bucket, value = features(marks)
        order = np.argsort(bucket, kind="stable")
        self.n, self.mark, self.bucket, self.value = len(marks), mark[order], bucket[order], value[order]
        self.starts = np.searchsorted(self.bucket, np.arange(BUCKETS + 1))
        values, vectors = np.linalg.eigh(self.kernel(marks))
        good = values > 1e-4
        self.whiten = vectors[:, good] / np.sqrt(values[good])

    def kernel(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.n))
        for a in range(0, len(texts), 256):
            part = texts[a : a + 256]
            r, k, v = features(part)
            times = self.starts[k + 1] - self.starts[k]
            at = np.repeat(self.starts[k] - np.cumsum(times) + times, times) + np.arange(times.sum())  # every landmark entry of the bucket
            cell = np.repeat(r, times) * self.n + self.mark[at]
            out[a : a + len(part)] = np.bincount(cell, np.repeat(v, times) * self.value[at], len(part) * self.n).reshape(len(part), self.n)
        return out

    def project(self, texts: list[str]) -> np.ndarray:
        return self.kernel(texts) @ self.whiten

    def by_bucket(self, w: np.ndarray) -> np.ndarray:
        """Weights of the projected features as one weight per bucket."""
        return np.bincount(self.bucket, self.value * (self.whiten @ w)[self.mark], BUCKETS)


def _svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a squared-hinge SVM with a constant at the end, by Newton steps over its active rows."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge
    keep[-1, -1] = 1e-3
    for _ in range(30):
        on = y * (x @ w) < 1
        cx = x[on] * c[on, None]
        new = np.linalg.solve(keep + x[on].T @ cx, cx.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def _log_odds(bags: list[list[str]], labels: list[int], weight: float) -> dict[str, float]:
    """Smoothed log odds of each word by the texts that hold it; words of a single abusive text give no evidence for it."""
    counts: dict[str, list[int]] = {}
    for b, y in zip(bags, labels, strict=True):
        for w in {w for p in b for w in p.split()}:
            counts.setdefault(w, [0, 0])[y] += 1
    n_bad, n_good = max(1, sum(labels)), max(1, len(labels) - sum(labels)) * weight
    odds = {w: float(np.log((k + 0.3) / (n_bad + 0.6)) - np.log((n * weight + 0.3) / (n_good + 0.6))) for w, (n, k) in counts.items()}
    return {w: o if counts[w][1] > 1 else min(o, 0.0) for w, o in odds.items()}


def fit(texts: list[str], labels: list[int], weight: float = 1.0, seed: int = 7) -> np.ndarray:
    """BUCKETS weights and a constant, from whole texts with verdicts 1 and 0; a constant -1 where a verdict is missing.

    weight says for how many clean texts of the labels each one given here stands. A fifth of the texts is held out of
    the fit: where their verdicts turn from clean to abusive becomes the threshold.
    """
    flat = np.zeros(BUCKETS + 1)
    flat[-1] = -1.0
    everything = [passages(t) for t in texts]
    aside = [zlib.crc32(t.encode(errors="replace")) % 5 == 0 for t in texts]
    bags = [b for b, o in zip(everything, aside, strict=True) if not o]
    ys = [y for y, o in zip(labels, aside, strict=True) if not o]
    held: dict[str, list[int]] = {}
    for b, y in zip(bags, ys, strict=True):
        for p in b:
            held.setdefault(p, [0, 0])[y] += 1
    odds = _log_odds(bags, ys, weight)
    bad = [b for b, y in zip(bags, ys, strict=True) if y == 1 and b]
    clean = sorted(p for p, (n, _) in held.items() if n)
    if not bad or not clean:
        return flat
    first = {p: sum(sorted((odds[w] for w in p.split()), reverse=True)[:4]) for b in bad for p in b}
    seeds = sorted({max(b, key=first.__getitem__) for b in bad})
    rng = np.random.default_rng(seed)
    marks = [seeds[i] for i in rng.permutation(len(seeds))[: LANDMARKS // 2]]
    marks += [clean[i] for i in rng.permutation(len(clean))[: LANDMARKS - len(marks)]]
    lands = _Landmarks(marks)
    options = sorted({p for b in bad for p in b})
    place = {p: i for i, p in enumerate(options)}
    xo = lands.project(options)
    # clean passages: a random part, and in every round those of all others that score worst
    used = {clean[i] for i in rng.permutation(len(clean))[:NEGATIVES]} | {p for p in options if held[p][0]}
    names = sorted(used)
    xn = lands.project(names)
    pick = np.array([place[max(b, key=first.__getitem__)] for b in bad])
    w = None
    for step in range(ROUNDS):
        n_of = np.array([held[p][0] for p in names]) * weight
        up, times = np.unique(pick, return_counts=True)
        sure = np.array([held[options[i]][1] > weight * held[options[i]][0] for i in up])
        up, times = up[sure], times[sure]
        if not len(up):
            return flat
        x = np.vstack([xo[up], xn])
        y = np.concatenate([np.ones(len(up)), -np.ones(len(names))])
        c = np.concatenate([COST * times, COST * n_of])  # a passage counts once per text that holds it
        w = _svm(x, y, c)
        so = xo @ w[:-1] + w[-1]
        # of each abusive text: its worst passage and every other that is clearly on the wrong side
        pick = np.array([i for b in bad for i in {max((place[p] for p in b), key=so.__getitem__), *(place[p] for p in b if so[place[p]] > 0.5)} if so[i] > -0.5], dtype=np.int64)
        if not len(pick):
            return flat
        flat_w = np.concatenate([lands.by_bucket(w[:-1]), w[-1:]])
        rest = [p for p in clean if p not in used]
        value = scores(rest, flat_w) if rest else np.zeros(0)
        more = [rest[i] for i in np.argsort(-value, kind="stable")[:NEGATIVES] if value[i] > -0.7]
        if more:
            used.update(more)
            names += more
            xn = np.vstack([xn, lands.project(more)])
    model = np.concatenate([lands.by_bucket(w[:-1]), w[-1:]])
    out = [(max(scores(b, model)) if b else -1.0, y) for b, y, o in zip(everything, labels, aside, strict=True) if o]
    model[-1] -= _threshold(np.array([s for s, _ in out]), np.array([y for _, y in out]), weight)
    return model


def _threshold(s: np.ndarray, y: np.ndarray, weight: float) -> float:
    """The score next to 0 whose wrong sides over held-out verdicts are the fewest, up to one standard error."""
    grid = np.linspace(-0.9, 0.9, 181)
    wrong = np.array([((s <= t) & (y == 1)).sum() + weight * ((s > t) & (y == 0)).sum() for t in grid])
    best = grid[wrong <= wrong.min() + np.sqrt(wrong.min())]
    return float(best[np.argmin(np.abs(best))])


def verdicts(labels: DataFrame) -> DataFrame:
    """doc_id, abusive by majority of the annotators, repeated rows once; ties and texts without verdict give no row."""
    once = labels.where("doc_id IS NOT NULL AND abusive IN (0, 1)").groupBy("doc_id", "annotator").agg(F.max("abusive").alias("a"))
    return once.groupBy("doc_id").agg(F.avg("a").alias("a")).where("a <> 0.5").select("doc_id", (F.col("a") > 0.5).cast("int").alias("abusive"))


def sampled(labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> tuple[DataFrame, float]:
    """doc_id and abusive of at most sample labelled texts of each verdict, and for how many clean texts each clean one stands
    relative to the abusive ones, so that the fit keeps the mix of the labels."""
    v = verdicts(labels)
    n = {r.abusive: r.n for r in v.groupBy("abusive").agg(F.count("*").alias("n")).collect()}
    share = [min(1.0, sample[y] / max(1, n.get(y, 0))) for y in (0, 1)]
    # a threshold on the hash, a little low, so that no task sends more rows than stay
    low = [x if x == 1.0 else x * (1 - 4 / max(4.0, sample[y]) ** 0.5) for y, x in enumerate(share)]
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return v.where(at < F.when(F.col("abusive") == 1, F.lit(low[1])).otherwise(F.lit(low[0]))), low[1] / low[0]


def train(documents: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> np.ndarray:
    """The model, from at most sample texts of each verdict; documents is read once."""
    ids, weight = sampled(labels, sample)
    texts = documents.select("doc_id", "text").where("text <> ''").join(F.broadcast(ids), "doc_id")  # at most sum(sample) ids
    rows = sorted((r.doc_id, r.text, r.abusive) for r in texts.collect())
    return fit([r[1] for r in rows], [r[2] for r in rows], weight)


def scored(documents: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id and score (positive: abusive) of every text; null, empty and wordless texts score -1.

    Other columns are ignored. Equal texts have equal scores; every row of documents gives one row.
    """
    weights = model.astype(np.float64)

    def run(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                part = pdf.iloc[a : a + 256]
                texts = [t if isinstance(t, str) else None for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].values, "score": text_scores(texts, weights)})

    return spread(documents.select("doc_id", "text")).mapInPandas(run, "doc_id long, score double")
