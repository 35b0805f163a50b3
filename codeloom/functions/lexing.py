"""A string- and comment-aware scan of source text, one state machine per language family.

Each family is one regular expression whose alternatives are the states that are not plain code; the scan jumps from
one to the next, so plain code is never looked at character by character.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_DQ = r'"(?:\\[\s\S]|[^"\\\n])*"?'
_SQ = r"'(?:\\[\s\S]|[^'\\\n])*'?"
_BLOCK = r"/\*[\s\S]*?(?:\*/|\Z)"
_LINE = r"//[^\n]*"
_HASH = r"\#[^\n]*"

_FAMILIES = {
    "js": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>{_DQ}|{_SQ}|`(?:\\[\s\S]|[^`\\])*`?)|(?P<r>(?<=[=(,:\[!&|?{{}};\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)",
    "c": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>(?:\bR\"(?P<d>[^ ()\\]{{0,16}})\([\s\S]*?(?:\)(?P=d)\"|\Z))|{_DQ}|(?<![0-9a-fA-F])'(?:\\[\s\S]|[^'\\\n])*'?)",
    "java": rf'(?P<c>{_LINE}|{_BLOCK})|(?P<s>"""[\s\S]*?(?:"""|\Z)|{_DQ}|{_SQ})',
    "go": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>`[^`]*`?|{_DQ}|{_SQ})",
    "rust": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>\bb?r(?P<d>\#*)\"[\s\S]*?(?:\"(?P=d)|\Z)|\"(?:\\[\s\S]|[^\"\\])*\"?|b?'(?:\\[^\n]{{1,9}}?|[^'\\\n])')",
    "python": rf"(?P<c>{_HASH})|(?P<s>(?:\b[rRuUbBfF]{{1,2}})?(?:\"\"\"(?:\\[\s\S]|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\[\s\S]|[^\\])*?(?:'''|\Z)|{_DQ}|{_SQ}))",
    "ruby": rf"(?P<c>{_HASH}|^=begin\b[\s\S]*?(?:^=end\b[^\n]*|\Z))|(?P<s>\"(?:\\[\s\S]|[^\"\\])*\"?|'(?:\\[\s\S]|[^'\\])*'?)",
}
_COMPILED = {k: re.compile(v, re.M) for k, v in _FAMILIES.items()}

FAMILY = {
    "typescript": "js",
    "tsx": "js",
    "javascript": "js",
    "jsx": "js",
    "python": "python",
    "go": "go",
    "rust": "rust",
    "java": "java",
    "c": "c",
    "cpp": "c",
    "ruby": "ruby",
}


def spans(text: str, language: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every comment ('c'), string ('s') and regular expression ('r'), in order."""
    return [(m.start(), m.end(), m.lastgroup if m.lastgroup != "d" else "s") for m in _COMPILED[FAMILY[language]].finditer(text)]


def masked(text: str, found: list[tuple[int, int, str]], keep: str = "") -> str:
    """text with every span not of a kind in keep blanked out, line breaks and length kept."""
    parts, at = [], 0
    for a, b, kind in found:
        if kind in keep:
            continue
        inner = text[a:b]
        parts += [text[at:a], " " * (b - a) if "\n" not in inner else "\n".join(" " * len(x) for x in inner.split("\n"))]
        at = b
    parts.append(text[at:])
    return "".join(parts)


class Lines:
    """Offsets to 1-based lines."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def of(self, offset: int) -> int:
        return bisect_right(self.starts, offset)


def body_end(code: str, start: int, language: str, starts: list[int]) -> int:
    """Offset behind the function that is declared at start of the masked text: its matching brace, the last deeper
    indented line (Python), the end at its own indentation (Ruby), or the ; of a declaration without body."""
    if language in ("python", "ruby"):
        first = bisect_right(starts, start) - 1
        line = code[starts[first] : code.find("\n", starts[first]) if code.find("\n", starts[first]) >= 0 else len(code)]
        indent = len(line) - len(line.lstrip())
        i, depth, last = first, 0, len(code)
        while i < len(starts):
            a = starts[i]
            b = starts[i + 1] if i + 1 < len(starts) else len(code)
            row = code[a:b]
            own = len(row) - len(row.lstrip())
            if i > first and row.strip():
                if language == "ruby" and own <= indent and re.match(r"\s*end\b", row):
                    return b
                if language == "python" and depth <= 0 and own <= indent:
                    return a
            depth += sum(row.count(x) for x in "([{") - sum(row.count(x) for x in ")]}")
            i += 1
        return last
    depth = round_ = 0
    for m in re.compile(r"[{}()\[\];]").finditer(code, start):
        x = m.group()
        if x in "([":
            round_ += 1
        elif x in ")]":
            round_ -= 1
        elif x == "{":
            depth += 1
        elif x == "}":
            depth -= 1
            if depth <= 0 and round_ <= 0:
                return m.end()
        elif depth == 0 and round_ <= 0:
            return m.end()
    return len(code)
