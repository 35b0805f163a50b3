"""What a source text itself tells about who wrote it: banners, minification, bulk data, repeated structure."""

from __future__ import annotations

import re

from codeloom.functions.lexing import masked, spans

# What tools write into the files that they emit.
_BANNER = re.compile(
    r"(?i)code generated by|auto-?generated (?:by|from|file)|^auto-?generated>|automatically (?:generated|created|produced) by|@generated\b|<auto-?generated|\bdo not (?:edit|modify|change)\b|"
    r"(?:file|code|source) (?:is|was|has been) (?:auto\w* )?(?:generated|produced|created) (?:by|from)|^\W*generated (?:by|from|with)\b|^\W*output of \S+ --|wurde von \S+ erzeugt|nicht von hand|"
    r"(?:fichier|code) (?:produit|généré) par|ne pas modifier|(?:archivo|código) generado|no (?:editar|modificar)|\bregenerate with\b|changes will be (?:lost|overwritten)"
)
_BY_HAND = re.compile(r"(?i)\b(?:edit(?:ed)?|kept|written|maintained) by hand\b")
_LIBRARY = re.compile(
    r"(?i)^\W*(?:@license\s+)?[\w.@/-]+ v?\d+\.\d+\.\d+\b(?:\W|$)(?=.*(?:\(c\)|vendored|upstream|licen[cs]e|copyright|contributors|https?:)|\W*$)|\bvendored (?:copy|from)\b|^\W*\(c\) the \S+ contributors|\bupstream [0-9a-f]{7,40}\b"
)
_NUMBER = re.compile(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[uUlLfF]?(?![\w.])")
_FUNCTION = re.compile(r"\bfunction\b|=>|\bdef\s+\w|\bfunc\s|\bfn\s+\w|\w\([^;{}()\n]{0,200}\)\s*\{|\breturn\b|\bif\b|\bwhile\b")
_IDENT = re.compile(r"[^\W\d]\w*")

#: Least share of literals for bulk data, least characters of it; least share of long dense lines for minified text.
DATA_SHARE, DATA_CHARS = 0.6, 200
DENSE_LINE, DENSE_SHARE, DENSE_SPACE = 150, 0.5, 0.10
#: Most distinct line shapes per line, and least lines, of text that a tool unrolled; least share of its lines in one run
#: whose shapes repeat in turn, most lines of a turn, least times that it comes.
SHAPES, SHAPE_LINES = 0.4, 12
TURN_SHARE, TURN_LINES, TURN_TIMES = 0.75, 12, 5


def _plain(text: str, found: list[tuple[int, int, str]]) -> list[str]:
    lines = [re.sub(r"^[\s/*#!<-]+|[\s*/>-]+$", "", x) for a, b, _ in found for x in text[a:b].split("\n")]
    return [x for x in lines if x]


def head_comments(text: str, found: list[tuple[int, int, str]]) -> list[str]:
    """Lines of the comments before the first two lines of code."""
    out, at = [], 0
    code = 0
    for a, b, kind in found:
        code += sum(1 for x in text[at:a].split("\n") if x.strip())
        at = b
        if code > 1 or kind != "c":
            break
        out.append((a, b, kind))
    return _plain(text, out)


def end_comments(text: str, found: list[tuple[int, int, str]]) -> list[str]:
    """Lines of the comments behind the last line of code, and of a comment at the end of that line."""
    out, at = [], len(text)
    for a, b, kind in reversed(found):
        if kind != "c" or text[b:at].strip():
            break
        out.append((a, b, kind))
        at = a
    return _plain(text, out[::-1])


def _tells_tool(block: list[str]) -> bool:
    """Whether a line of a block of comments, or two that run on, says that a tool wrote the file, and none tells of work
    by hand."""
    return any(_BANNER.search(x) for x in [*block, *map(" ".join, zip(block, block[1:], strict=False))]) and not _BY_HAND.search(" ".join(block))


def shapes(code: str) -> list[str]:
    """Shapes of the non-blank lines: names and numbers made equal."""
    return [_NUMBER.sub("9", _IDENT.sub("w", x)) for x in map(str.strip, code.split("\n")) if x]


def turns(lines: list[str]) -> float:
    """Share of the lines in the longest run that repeats a turn of 2 to TURN_LINES shapes, TURN_TIMES or more.

    People write statements of few shapes too, but in no fixed order; a table of equal lines is no turn.
    """
    best, n = 0, len(lines)
    for p in range(2, TURN_LINES + 1):
        run = 0
        for i in range(p, n):
            run = run + 1 if lines[i] == lines[i - p] else 0
            if run >= (TURN_TIMES - 1) * p and run + p > best and len(set(lines[i - p + 1 : i + 1])) > 1:
                best = run + p
    return best / max(1, n)


def traits(text: str, lang: str) -> dict[str, bool]:
    """banner, library, minified, data and unrolled of one text; all false for an empty one."""
    found = spans(text, lang)
    head, end = head_comments(text, found), end_comments(text, found)
    banner = _tells_tool(head) or _tells_tool(end)
    library = any(_LIBRARY.search(x) for x in [*head, *end])
    bare = masked(text, [x for x in found if x[2] == "c"])
    plain = masked(text, found)
    solid = len(re.sub(r"\s+", "", bare))
    strings = sum(len(re.sub(r"\s+", "", text[a:b])) for a, b, k in found if k == "s")
    numbers = sum(len(m.group()) + 1 for m in _NUMBER.finditer(plain))
    literal = strings + numbers
    works = bool(_FUNCTION.search(plain))
    data = solid >= DATA_CHARS and literal >= DATA_SHARE * solid and not works
    long = [x for x in bare.split("\n") if len(x) > DENSE_LINE]
    n_long = sum(map(len, long))
    space = sum(x.count(" ") + x.count("\t") for x in long)
    minified = not data and n_long >= DENSE_SHARE * max(1, len(bare.strip())) and space <= DENSE_SPACE * n_long and works and strings < 0.5 * solid
    rows = shapes(plain)
    n = len(rows)
    comments = sum(1 for a, b, k in found if k == "c")
    unrolled = not data and n >= SHAPE_LINES and len(set(rows)) <= SHAPES * n and comments <= 2 + n // 50 and turns(rows) >= TURN_SHARE
    return {"banner": banner, "library": library, "minified": minified, "data": data, "unrolled": unrolled}
