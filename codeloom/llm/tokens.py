"""Token counts by a public tokenizer's vocabulary: those of codeloom.functions.tokens."""

from codeloom.functions.tokens import PATTERN, VOCABULARY, encoding, n_tokens

__all__ = ["PATTERN", "VOCABULARY", "encoding", "n_tokens"]
