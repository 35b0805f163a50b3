"""Token counts and token-bounded prefixes by a public tokenizer's vocabulary, given by path."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Byte-level BPE vocabulary as ranks; the path is a parameter everywhere and must exist on every executor.
VOCABULARY = os.environ.get("CODELOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# The pattern that splits a text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict = {}


def encoding(path: str = VOCABULARY, pattern: str = PATTERN):
    """The encoding of a vocabulary file, loaded once per worker."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def n_tokens(text: Column, path: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """Number of tokens of the whole text; 0 for null and empty texts."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        e = encoding(path, pattern)
        return pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def prefix(text: str, budget: int, mark: str = "…", path: str = VOCABULARY, pattern: str = PATTERN) -> str:
    """text if it has at most budget tokens, else its longest start of at most budget - 1 tokens and a mark.

    A start of the text has at least as many tokens as one shorter by a whole token, so the search begins where the
    tokens of the text end and moves by characters only from there.
    """
    e = encoding(path, pattern)
    ids = e.encode_ordinary(text)
    if len(ids) <= budget:
        return text
    low = len(e.decode_bytes(ids[: max(0, budget - 1)]).decode("utf-8", "ignore")) if budget > 1 else 0
    high = min(len(text), len(e.decode_bytes(ids[: budget + 8]).decode("utf-8", "ignore")))
    while low > 0 and len(e.encode_ordinary(text[:low])) > budget - 1:
        low -= 1
    for end in range(low + 1, high + 1):
        if len(e.encode_ordinary(text[:end])) <= budget - 1:
            low = end
    return text[:low].rstrip() + (" " + mark if low else "")


def truncated(text: Column, budget: int, mark: str = "…", path: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """prefix of every text; null stays null."""

    @F.pandas_udf(T.StringType())
    def cut_off(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else prefix(t, budget, mark, path, pattern))

    return cut_off(text)
