"""Problem 5: credentials in source code, configuration and text.

Every value that could be a credential (assigned values, words of random-looking characters, passwords in addresses and
connection strings, headers of keys) is a candidate with its identifier and place. Pattern matches label some of them
weakly; two character Markov models are counted over those labels, and a logistic regression over the models'
likelihoods, the shape of the value, the identifier and the path scores all candidates. Scores above THRESHOLD are
masked by characters of equal number, so quotes, brackets and line breaks around them stay as they are.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut, small, spread

#: Most different candidates that the fit takes, by a hash of the value; least probability of a credential.
SAMPLE = 30_000
THRESHOLD = 0.5
NAME_BUCKETS = 256
#: Penalty of the squared weights of the regression.
RIDGE = 2.0
#: Longest value that is matched against words; longer ones are none.
WORDS_MOST = 64

# A name is taken from the start of its run of characters and never given back, so long lines cost no more than short ones.
_ASSIGNED = re.compile(r"""(?<![\w.\-])(?:[^\WA-Za-z_]|[.\-])*+(?P<n>[A-Za-z_][\w.\-]*+)["']?\]?(?:\s*:\s*[\w<>\[\], ]{1,30}?\s*=|\s*(?:=>|:=|[:=]))\s*(?:[\w:.]{1,20}\()?(?:[bfru]{0,2}(?P<q>["'`])(?P<v>(?:\\.|(?!(?P=q)).){4,2000}(?=(?P=q))|[^\s"'`]{2001,})(?P=q)|(?P<b>[^\s"'`,;(){}\[\]<>]{6,})(?![\w(.\[]))""")
# A further literal of the same value: next to the last one on its line, or on the next line after an operator.
_JOINED = re.compile(r"""(?:[ \t]*(?:\+|\.\.|\\)[ \t]*(?:\r?\n[ \t]*)?|[ \t]*\r?\n[ \t]*(?:\+|\.\.)[ \t]*|[ \t]*)[bfru]{0,2}(?P<q>["'`])(?P<v>(?:\\.|(?!(?P=q))[^\n\\])+)(?P=q)""")
_AUTH = re.compile(r"(?i)\b(?P<n>bearer|basic|authorization|password|passwort|passwd|pwd|token|secret|api[ _-]?key|mot de passe|contrase.a)\s*(?:is|ist|:|=|est|es)?\s+[\"'`]?(?P<v>[^\s\"'`,;]{8,})")
_WORD = re.compile(r"(?<![\w+/=.-])(?=[\w+/=.-]*\d)(?=[\w+/=.-]*[A-Za-z])[\w+/=.-]{16,}")
_URL = re.compile(r"[a-z][a-z0-9+]{1,15}://(?P<u>[^\s:/@\"'`]*):(?P<v>[^\s/@\"'`]{3,})@")
_CONNECT = re.compile(r"(?i)[;\s\"'](?P<n>pwd|password)=(?P<v>[^;\"'\s]{4,})")
_BASIC = re.compile(r"(?i)\bbasic[ \t]+(?P<v>[A-Za-z0-9+/]{8,}={0,2})(?![A-Za-z0-9+/=])")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)-----")
_KEY_LINE = re.compile(r"(?:[\s\"'`+,;#*>|()-]|\\[nr\\])*([A-Za-z0-9+/=]+)(?:[\s\"'`+,;)}\]\\]|\\[nr])*")

# Formats that issuers publish for their credentials.
_FORMAT = re.compile(
    r"^(?:A[KS]IA(?=[0-9A-Z]{16}$)|gh[pousr]_(?=\w{20,}$)|github_pat_|glpat-|(?:sk|rk|pk)_(?:live|test)_|sk-(?:proj-|ant-)?(?=[\w-]{20,}$)|xox[abeprs]-|AIza(?=[\w-]{30,}$)|ya29\.|SG\.|npm_(?=\w{30,}$)|hf_(?=\w{20,}$)|pypi-|dop_v1_|eyJ(?=[\w-]+\.[\w-]*\.?[\w-]*$)|AGE-SECRET-KEY-)"
)
# Forms that are never credentials.
_DIGEST = re.compile(r"(?i)^(?:(?:sha\d*|md5)[:=-].*|data:.*|[0-9a-f]{7,16}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|\{?[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\}?|ssh-(?:rsa|ed25519) .*|-----BEGIN (?:[A-Z ]*PUBLIC KEY|CERTIFICATE).*|\d[\d.:TZ+\-/ ]*|v?\d+\.\d+.*)$", re.S)
_PLACEHOLDER = re.compile(
    r"(?i)(?:^(?:change.?me|replace.?me|your.?|my.?|todo|tbd|none|null|true|false|undefined|example|dummy|sample|fake|test|redacted|placeholder|insert|secret|password|passwd|token|hunter2?)(?:$|[ _.-])|x{4,}|\*{3,}|\.{3}|•|<[^>]*>|\$\{|\$\(|\{\{|%\(|(?<![A-Za-z0-9])%[sd](?![A-Za-z0-9])|^\$\w|\benv\b|environ|getenv|process\.|vault:|vault/|secrets?\.|secretref|keyring[.:]|^ref\+|arn:|ssm:|^(.)\1*$|_here$|^0+$|1234567|abcdef|example(?:key|token)|redacted|replace_?me|changeme|your_)"
)
# Values made of words: names, members, calls, types, paths, prose.
_WORDS = re.compile(r"(?:[^\W\d_]?[^\W\dA-Z_]{2,}+|[A-Z]{2,}+|[aA]|I|[\s\W_]|\d(?!\w))*+|[\w.$]{3,}\(.*\)[;,]?|.*(?:=>|::|\{[A-Za-z_]{3,}\}|</?\w+>).*|[\w.-]*+(?:/(?=[\w.-]*[a-z]{3})[\w.-]*+)+", re.S)
# Constants, numbers, and plain names with a number.
_PLAIN = re.compile(r"[A-Z][A-Z0-9_]*|[-+]?[\d.,:]+|[a-z]+(?:[_-][a-z]+)*[_-]?\d{0,3}")
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_SECRET_NAME = re.compile(r"(?i)secret|passw|pwd|token|api.?key|apikey|credential|auth|private|signing|access.?key|bearer|dsn|conn|mot de passe|contras|[_-]key$|login|(?:^|[_-])pw$")


def body(value: str) -> str:
    """The value without the prefix of a published format."""
    m = _FORMAT.match(value)
    return value[m.end() :] if m else value


def key_end(text: str, at: int) -> int:
    """End of the key whose header ends at an offset: its -----END where most lines before it are base64, else the end of
    the base64 lines that follow, at itself where none do."""
    end, other = text.find("-----END", at), text.find("-----BEGIN ", at)
    if end >= 0 and (other < 0 or end < other):
        lines = [x for x in re.split(r"\n|\\n", text[at:end]) if re.search(r"\w", x)]
        if len(lines) <= 2 * sum(bool(_KEY_LINE.fullmatch(x)) for x in lines):
            return end
    last, solid = at, False
    for m in re.finditer(r"(?:\\(?!n)|[^\n\\])*(?:\n|\\n|$)", text[at:]):
        line = re.sub(r"(?:\\n|\n)$", "", m.group())
        k = _KEY_LINE.fullmatch(line)
        if k and (len(k.group(1)) >= 16 or solid and re.search(r"\d|[+/=]|[a-z][A-Z]", k.group(1))):
            last, solid = at + m.start() + k.end(1), True
        elif re.search(r"\w", line) and (solid or not re.match(r"\W*(?:Proc-Type|DEK-Info|Comment|Version)\b", line)):
            # the key may share its last line with other text
            k = re.match(r"[\s\"'`+,#*>|-]*([A-Za-z0-9+/=]{16,})(?![\w-])", line)
            return at + m.start() + k.end(1) if k else last
        if m.end() == len(text) - at:
            break
    return last


def _decoded(value: str) -> str:
    """Printable text behind base64; '' for anything else."""
    try:
        t = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except ValueError:
        return ""
    return t if t.isprintable() else ""


def candidates(text: str) -> list[tuple[int, int, int, str, str, str]]:
    """(line, start, end, name, value, how) of every possible credential; start and end are offsets in the text.

    A value written in several literals gives one row per literal, all with the whole value and its first line.
    """
    out, at = [], 0
    lines = text.split("\n")
    key_until = 0
    joined: list[tuple[int, int]] = []  # literals of values that began on an earlier line
    dense = [len(x) > 24 and bool(re.fullmatch(r"[\s\"'`+,]*[A-Za-z0-9+/=]{20,}[\s\"'`+,;)\\]*", x)) for x in lines]
    for no, line in enumerate(lines, 1):
        start, at = at, at + len(line) + 1
        if at - 1 <= key_until or len(line) < 8:
            continue
        near = (no > 1 and dense[no - 2]) or (no < len(lines) and dense[no])
        joined = [x for x in joined if x[1] > start]
        taken = sorted((a - start, b - start) for a, b in joined)  # never overlap
        if key_until > start:
            taken.insert(0, (0, key_until - start))

        def add(m, group, name, how, no=no, start=start, taken=taken, joined=joined):
            a, b = m.span(group)
            i = bisect_left(taken, (a, b))
            if (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b):
                return
            taken.insert(i, (a, b))
            value, more = m.group(group), []
            if how == "quoted":
                end = start + m.end()
                while n := _JOINED.match(text, end):
                    more.append(n.span("v"))
                    value, end = value + n.group("v"), n.end()
            for c, d in [(start + a, start + b), *more]:
                out.append((no, c, d, name, value, how))
            joined.extend(more)
            for c, d in more:
                insort(taken, (c - start, d - start))

        for m in _PEM.finditer(line) if "-----BEGIN " in line else ():
            if start + m.start() < key_until:
                continue
            out.append((no, start + m.start(), start + m.end(), "", m.group(), "pem"))
            key_until = key_end(text, start + m.end())
            insort(taken, (m.start(), max(m.end(), key_until - start)))
        for m in _BASIC.finditer(line) if "asic" in line or "ASIC" in line else ():
            user, _, word = _decoded(m.group("v")).partition(":")
            if word:
                a, b = m.span("v")
                out.append((no, start + a, start + b, user, word, "basic"))
                insort(taken, (a, b))
        for m in _URL.finditer(line) if "://" in line else ():
            add(m, "v", m.group("u"), "url")
        for m in _CONNECT.finditer(line) if "=" in line else ():
            add(m, "v", m.group("n"), "connection")
        for m in _ASSIGNED.finditer(line):
            if m.group("v"):
                add(m, "v", m.group("n"), "quoted")
            else:
                add(m, "b", m.group("n"), "bare")
        for m in _AUTH.finditer(line):
            add(m, "v", m.group("n"), "said")
        for m in _WORD.finditer(line):
            if re.search(r"(?i)(?:base64,|sha\d+[:=-])$", line[max(0, m.start() - 9) : m.start()]):
                continue
            add(m, 0, "", "dense" if near else "word")
    return out


def weak(name: str, value: str, how: str) -> int:
    """Label by pattern matches: 1 a published format or place of credentials, 0 clearly none, -1 unknown."""
    if how == "pem":
        return int("PRIVATE KEY" in value)
    if _PLACEHOLDER.search(value) or _DIGEST.match(value):
        return 0
    if _FORMAT.match(value):
        return 1
    if how in ("url", "connection", "basic"):
        return 1
    # words, names, calls and types are clear; other values without digits or with brackets are not under a telling name
    if how != "word" and _SECRET_NAME.search(name) and 8 <= len(value) <= WORDS_MOST and (not re.search(r"\d", value) or re.search(r"[(){}<>]", value)) and not _WORDS.fullmatch(value):
        return -1
    if not re.search(r"\d", value) or " " in value or re.search(r"^[\w./-]*/[\w.-]+\.\w{1,4}$|[(){}<>]|^https?://[^@]*$|::|^\.{0,2}/", value):
        return 0
    if _PLAIN.fullmatch(value) and not (_SECRET_NAME.search(name) and len(value) > 11 and re.search(r"\d", value)):
        return 0
    if len(value) > 120 and not _SECRET_NAME.search(name):
        return 0
    if how == "dense":
        return 0
    if how == "word" and ("=" in value.rstrip("=") or len({(c.islower(), c.isupper(), c.isdigit()) for c in value}) < 3):
        return 0
    if re.search(r"(?i)(?:^|[_.-])(?:id|lat|lon|version|date|time|line|tag|hash|sha|digest|integrity|checksum)$", name) and not _FORMAT.match(value) and len(value) < 12:
        return 0
    return -1


def _classes() -> np.ndarray:
    """Class below 32 of every character up to U+007F: a few letters to a class, and one class for all characters beyond."""
    out = np.full(129, 30, np.int64)
    for n in range(128):
        c = chr(n)
        if c.isspace():
            out[n] = 0
        elif c in "aeiouAEIOU":
            out[n] = 1
        elif "a" <= c <= "z":
            out[n] = 2 + (n - 97) // 3
        elif "A" <= c <= "Z":
            out[n] = 12 + (n - 65) // 5
        elif c.isdigit():
            out[n] = 19
        elif c in "+/=_-.:@!":
            out[n] = 20 + "+/=_-.:@!".find(c)
    return out


_CLASS = _classes()
_SIDE = re.compile(r"[(){}<>\s]|^\.{0,2}/|/[\w.-]+\.\w{1,4}$|::")
_SEGMENT = re.compile(r"[A-Za-z0-9]+")
_CONFIG = ("env", "yml", "yaml", "toml", "properties", "json", "ini", "conf")


class _Chars:
    """The characters of many strings, one after the other: row, code and class of each."""

    def __init__(self, values: list[str]):
        self.size = np.array([len(v) for v in values], np.int64)
        self.row = np.repeat(np.arange(len(values)), self.size)
        self.code = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.kind = _CLASS[np.minimum(self.code, 128)]
        self.first = np.concatenate([[True], self.row[1:] != self.row[:-1]]) if len(self.row) else np.zeros(0, bool)

    def moves(self) -> np.ndarray:
        """Transition at each character as a number below 32 * 32; the first of a string comes from class 31."""
        before = np.where(self.first, 31, np.concatenate([[31], self.kind[:-1]])) if len(self.kind) else self.kind
        return before * 32 + self.kind

    def mean(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, x, len(self.size)) / np.maximum(self.size, 1)


def transitions(rows) -> np.ndarray:
    """Character transitions of the labelled ones of (name, value, how) rows, by label."""
    counts = np.zeros((2, 1024))
    for y, values in _by_label(rows).items():
        counts[y] += np.bincount(_Chars(values).moves(), minlength=1024)
    return counts


def _by_label(rows) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {0: [], 1: []}
    for name, value, how in rows:
        y = label(name, value, how) if how != "pem" else -1
        if y >= 0:
            out[y].append(body(value))
    return out


def vectors(rows: list[tuple[str, str, str, str]], log_odds: np.ndarray) -> np.ndarray:
    """Features of (name, value, how, path) candidates: likelihoods, shape, identifier and place; whole values, in one go."""
    values = [body(r[1]) for r in rows]
    c = _Chars(values)
    n = np.maximum(c.size, 1)
    at, times = np.unique(c.row * 0x110000 + c.code, return_counts=True)
    share = times / n[at // 0x110000]
    entropy = -np.bincount(at // 0x110000, share * np.log2(share), len(rows))
    lower, upper, digit = (c.code >= 97) & (c.code <= 122), (c.code >= 65) & (c.code <= 90), (c.code >= 48) & (c.code <= 57)
    kind = lower * 1 + upper * 2 + digit * 3
    turn = np.concatenate([[False], kind[1:] != kind[:-1]]) & ~c.first if len(kind) else kind.astype(bool)
    has = [np.bincount(c.row, x, len(rows)) > 0 for x in (lower, upper, digit, ~(lower | upper | digit | (c.code == 95) | (c.kind == 0)))]
    classes, changes = np.sum(has, axis=0), c.mean(turn)
    longest = [max(_SEGMENT.findall(v), key=len, default="") for v in values]  # the random part between - and _
    s = _Chars(longest)
    letters = np.bincount(s.row, (s.code >= 65), len(rows))
    digits = np.bincount(s.row, (s.code < 58), len(rows))
    flags = np.array([
        [bool(_PLACEHOLDER.search(v)), bool(_DIGEST.match(v)), bool(_SECRET_NAME.search(k)), bool(_FORMAT.match(v)), bool(_SIDE.search(v)), len(v) <= WORDS_MOST and bool(_WORDS.fullmatch(v)), " " in v,
         h in ("url", "connection", "basic"), h == "word", h == "bare", h == "dense", q.rpartition(".")[2].lower() in _CONFIG, len(v) > 120, bool(_PLAIN.fullmatch(v)), len(v) < 8]
        for k, v, h, q in rows
    ], dtype=float).reshape(len(rows), 15)
    mixed = ((letters >= 4) & (digits >= 2) & (s.size >= 20)).astype(float)
    dense = np.column_stack([
        c.mean(log_odds[c.moves()]), s.mean(log_odds[s.moves()]), entropy / 4, np.minimum(n, 16) / 16, n > 80, np.minimum(s.size, 60) / 30, classes / 2, changes, c.mean(digit), ~has[2],
        (classes >= 3) & (n >= 14) & (changes > 0.25), mixed, flags[:, 2] * ((classes >= 3) & (n >= 8)), flags[:, 2] * mixed, flags[:, 3] * (1 - flags[:, 0]), flags[:, 13] * (1 - flags[:, 2]), flags[:, 5] * (1 - flags[:, 2]), flags,
    ])
    names = np.zeros((len(rows), NAME_BUCKETS))
    for i, r in enumerate(rows):
        for part in _NAME_PARTS.findall(r[0]):
            names[i, zlib.crc32(part.lower().encode()) % NAME_BUCKETS] = 0.25
    return np.hstack([dense, names])


class Model:
    """Markov log odds and the weights of the regression; its size does not depend on the data."""

    def __init__(self, log_odds: np.ndarray, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.log_odds, self.weights, self.mean, self.scale = log_odds, weights, mean, scale

    def logits(self, rows: list[tuple[str, str, str, str]]) -> np.ndarray:
        return ((vectors(rows, self.log_odds) - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1] if rows else np.zeros(0)

    def probabilities(self, rows: list[tuple[str, str, str, str]]) -> np.ndarray:
        """Calibrated probability of each candidate; a header of a key is one if it says so. Equal rows are scored once."""
        place = {r: i for i, r in enumerate(dict.fromkeys(r for r in rows if r[2] != "pem"))}
        p = 1 / (1 + np.exp(-np.clip(self.logits(list(place)), -30, 30)))
        return np.array([float("PRIVATE KEY" in r[1]) if r[2] == "pem" else p[place[r]] for r in rows])


def excluded(name: str, value: str, how: str) -> bool:
    """The exact check behind the score: masks, references, digests, public keys and whole assignments, and plain words and names that no
    telling name assigns, are no secrets whatever their score."""
    if how == "pem":
        return False
    if _PLACEHOLDER.search(value) or _DIGEST.match(value) or (how == "word" and "=" in value.rstrip("=")):
        return True
    return not _FORMAT.match(value) and how not in ("url", "connection", "basic", "said") and len(value) <= WORDS_MOST and bool(_WORDS.fullmatch(value) or _PLAIN.fullmatch(value)) and not _SECRET_NAME.search(name)


def label(name: str, value: str, how: str) -> int:
    """The weak label; a value with digits under a telling name, of no other known form, is like the published formats."""
    y = weak(name, value, how)
    return 1 if y < 0 and _SECRET_NAME.search(name) and len(value) >= 8 and re.search(r"\d", value) and not re.search(r"[\s(){}<>]", value) else y


def _regression(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression, the constant last, by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (c * (p * (1 - p) + 1e-6))[:, None]) + np.diag(ridge), z.T @ (c * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit(rows: list[tuple], counts: np.ndarray | None = None) -> Model:
    """The model from (name, value, how, path[, occurrences]) of candidates; without labels of both kinds it gives pattern matches only.

    counts are the transitions of all labelled candidates, those of rows if not given. A fifth of the values is held out
    of the regression; a second one on their scores (slope and constant) makes the probabilities those of the labels.
    """
    labelled = [(r, label(r[0], r[1], r[2])) for r in rows if r[2] != "pem"]
    labelled = [(r, y) for r, y in labelled if y >= 0]
    counts = (transitions(r[:3] for r in rows) if counts is None else counts) + 0.5
    rate = np.log((counts / counts.reshape(2, 32, 32).sum(2).repeat(32, 1)))
    odds = rate[1] - rate[0]
    if not labelled:
        labelled = [(("", "", "bare", ""), 0)]
    # unknown forms are only labelled under telling names: each also stands without one, so that the form itself counts
    labelled += [(("", r[1], h, r[3]), 1) for r, y in labelled if y == 1 and r[2] in ("quoted", "bare", "said") and not _FORMAT.match(r[1]) for h in ("quoted", "word")]
    x = vectors([r[:4] for r, _ in labelled], odds)
    y = np.array([float(v) for _, v in labelled])
    aside = np.array([zlib.crc32(r[1].encode(errors="replace")) % 5 == 0 for r, _ in labelled])
    mean, scale = x.mean(0), x.std(0) + 1e-2
    scale[-NAME_BUCKETS:] = 1.0
    mean[-NAME_BUCKETS:] = 0.0
    x = (x - mean) / scale
    times = np.array([1 + np.log(r[4]) if len(r) > 4 else 1.0 for r, _ in labelled])
    balance = np.where(y > 0, max(1.0, 0.3 * len(y) / max(1.0, y.sum())), 1.0) * times
    fitted = ~aside if y[~aside].any() else ~np.zeros_like(aside)
    w = _regression(x[fitted], y[fitted], balance[fitted], np.full(x.shape[1] + 1, RIDGE))
    if y[aside].sum() >= 20 and (y[aside] == 0).sum() >= 20:
        a, b = _regression((x[aside] @ w[:-1] + w[-1])[:, None], y[aside], balance[aside], np.array([0.1, 0.1]))
        if a > 0:
            w = np.concatenate([w[:-1] * a, [w[-1] * a + b]])
    return Model(odds, w, mean, scale)


def extracted(documents: DataFrame, symbols: DataFrame) -> DataFrame:
    """tbl, row_key, field, path, text_hash and each candidate of all texts, signatures and docstrings; nulls give no rows.

    A symbol delivered again may have another text, so text_hash tells which text the offsets belong to.
    """
    d = documents.where("doc_id IS NOT NULL AND text <> ''").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_key"), F.lit("text").alias("field"), F.coalesce("repo_path", F.lit("")).alias("path"), F.xxhash64("text").alias("text_hash"), "text")
    parts = [
        symbols.where(F.col("symbol_key").isNotNull() & (F.col(c) != "")).select(F.lit("symbols").alias("tbl"), F.col("symbol_key").alias("row_key"), F.lit(c).alias("field"), F.coalesce("file", F.lit("")).alias("path"), F.xxhash64(c).alias("text_hash"), F.col(c).alias("text"))
        for c in ("signature", "docstring")
    ]

    def run(batches):
        for pdf in batches:
            out = [(t, k, f, p, h, *c) for t, k, f, p, h, x in pdf.itertuples(index=False) for c in candidates(x)]
            yield pd.DataFrame(out, columns=["tbl", "row_key", "field", "path", "text_hash", "line_no", "at", "until", "name", "value", "how"])

    schema = "tbl string, row_key long, field string, path string, text_hash long, line_no int, at int, until int, name string, value string, how string"
    return spread(d.unionByName(parts[0]).unionByName(parts[1])).mapInPandas(run, schema)


def located(documents: DataFrame, symbols: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """tbl, row_key, field, text_hash, line_no, at, until and probability of every candidate at or above THRESHOLD."""
    found = cut(extracted(documents, symbols))
    each = cut(found.groupBy("value", "name", "how").agg(F.min("path").alias("path"), F.count("*").alias("n")))

    def count(batches):
        total = sum((transitions(pdf[["name", "value", "how"]].itertuples(index=False)) for pdf in batches), np.zeros((2, 1024)))
        y, pair = np.nonzero(total)
        yield pd.DataFrame({"y": y, "pair": pair, "n": total[y, pair]})

    counts = np.zeros((2, 1024))
    for r in each.mapInPandas(count, "y int, pair int, n double").groupBy("y", "pair").agg(F.sum("n").alias("n")).collect():  # at most 2,048 rows
        counts[r.y, r.pair] = r.n
    # half of the sample by different candidates, half by how often they occur: a threshold on the hash first, a little
    # high, so that no task sends more rows than the fit could take
    size = each.agg(F.count("*").alias("d"), F.sum("n").alias("n")).first()
    at = F.pmod(F.xxhash64("value", "name", "how"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    order = at / (F.lit(sample / 2 / max(1, size.d)) + F.lit(sample / 2 / max(1, size.n or 0)) * F.col("n"))
    taken = each.withColumn("order", order).where(F.col("order") < 1 + 4 / sample**0.5) if size.d > sample else each.withColumn("order", order)
    rows = [r[1:] for r in sorted(tuple(r) for r in taken.select("order", "name", "value", "how", "path", "n").collect())[:sample]]
    model = fit(sorted(rows), counts)

    def run(batches):
        for pdf in batches:
            rows = list(pdf[["name", "value", "how", "path"]].itertuples(index=False, name=None))
            out = np.array([excluded(*r[:3]) for r in rows], dtype=bool)
            p = np.zeros(len(rows))
            p[~out] = model.probabilities([r for r, o in zip(rows, out, strict=True) if not o])
            yield pdf[["tbl", "row_key", "field", "text_hash", "line_no", "at", "until"]].assign(probability=p)

    return found.mapInPandas(run, "tbl string, row_key long, field string, text_hash long, line_no int, at int, until int, probability double").where(F.col("probability") >= THRESHOLD)


def mask(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text with letters and digits of every span written as x, all else kept, and the number of spans masked; of the
    header of a private key, the key behind it."""
    n = 0
    for a, b in spans:
        if text.startswith("-----BEGIN", a):
            a, b = b, key_end(text, b)
        n += b > a
        text = text[:a] + re.sub(r"(?<!\\)[A-Za-z0-9]", "x", text[a:b]) + text[b:]
    return text, n


def _masked(texts: DataFrame, found: DataFrame, key: list[str], schema: str) -> DataFrame:
    spans = found.groupBy(*key).agg(F.collect_set(F.struct("at", "until")).alias("spans"))

    def run(batches):
        for pdf in batches:
            done = [(t, 0) if t is None or c is None else mask(t, [(x["at"], x["until"]) for x in c]) for t, c in zip(pdf["text"], pdf["spans"], strict=True)]
            yield pdf.drop(columns=["spans"]).assign(text=[t for t, _ in done], n_masked=np.array([n for _, n in done], dtype="int32"))

    return texts.join(small(cut(spans), 4096), key, "left").select(*texts.columns, "spans").mapInPandas(run, schema)


def masked_documents(documents: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text and n_masked of every document, its located spans masked."""
    found = found.where("tbl = 'documents'").withColumnRenamed("row_key", "doc_id")
    return _masked(documents.select("doc_id", "text"), found, ["doc_id"], "doc_id long, text string, n_masked int")


def masked_symbols(symbols: DataFrame, found: DataFrame) -> DataFrame:
    """row_key, field, text and n_masked of every signature and docstring, its located spans masked.

    Symbols delivered again give one row per different text; null keys and null texts give none.
    """
    f = [symbols.where(F.col("symbol_key").isNotNull() & F.col(c).isNotNull()).select(F.col("symbol_key").alias("row_key"), F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("signature", "docstring")]
    texts = f[0].unionByName(f[1]).distinct().withColumn("text_hash", F.xxhash64("text"))
    schema = "row_key long, field string, text string, text_hash long, n_masked int"
    return _masked(texts, found.where("tbl = 'symbols'"), ["row_key", "field", "text_hash"], schema).drop("text_hash")
