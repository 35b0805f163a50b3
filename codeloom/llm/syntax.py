"""Problem 2: source files that do not parse.

A text is cut into tokens by the state machine of functions.lexing and decided by a packrat grammar of its language
that must consume all of it. Failures carry the line of the furthest position and a cause. JavaScript, TypeScript and
Python have grammars down to expressions; Go, Rust, Java, C, C++ and Ruby down to declarations, statements, balanced
groups and the order of operands and operators.
"""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.lexing import Lines, spans
from codeloom.langs import EXTENSIONS, extension, is_source
from codeloom.llm import grammars as G
from codeloom.llm.peg import Grammar, compiled
from codeloom.session import spread

_PY_WORDS = set("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_PY_SOFT = {"match", "case", "type"}
_JS_WORDS = set("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
_JS_SOFT = set("let static async await get set of as from type interface namespace module declare abstract readonly public private protected override keyof unique infer is asserts satisfies implements yield global out".split())
_OP = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|//=|&&=|\|\|=|\?\?=|=>|->|:=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|<<|\*\*|::|[-+*/%=<>!&|^~?:;,.(){}\[\]@#$\\]")
_PY_OP = re.compile(r"\.\.\.|\*\*=|//=|>>=|<<=|->|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|<<|>>|\*\*|//|[-+*/%=<>&|^~:;,.(){}\[\]@]")
_NUM = re.compile(r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_']*(?:\.(?!\.)[\d_]*)?(?:[eE][-+]?\d+)?|\.\d[\d_]*(?:[eE][-+]?\d+)?)(?:[a-zA-Z]\w*)?")
_NUM_TAIL = {"python": r"[jJ]?", "js": r"n?", "java": r"[lLfFdD]?", "go": r"i?", "c": r"(?:[uU]?[lL]{0,2}|[lL]{1,2}[uU]?|[fF]|[uU]?[zZ])", "rust": r"_?(?:[iu](?:8|16|32|64|128|size)|f32|f64)?", "ruby": r"[ri]?"}
_WORDS = {"ruby": re.compile(r"(?:@{1,2}|\$)?[^\W\d]\w*(?:[?!](?![=~]))?|\$[\d!@&~;,/<>.]"), "js": re.compile(r"(?:[^\W\d]|\$)[\w$]*")}
_WORD = re.compile(r"[^\W\d]\w*")
_CONFLICT = re.compile(r"^(?:<{7}(?: |$)|>{7}(?: |$)|={7}$|\|{7}(?: |$))", re.M)
_KINDS = {".tsx": "tsx", ".jsx": "jsx", ".ts": "ts", ".mts": "ts", ".cts": "ts", ".js": "js", ".mjs": "js", ".cjs": "js"}
# Keywords of the languages with coarse grammars.
_KEYWORDS = {
    "go": frozenset("package import func var const type return if else for range switch case default go defer chan map struct interface select goto fallthrough break continue go".split()),
    "rust": frozenset("use mod struct union enum trait unsafe impl static const type fn async extern crate pub let mut return if else match for in while loop as ref move dyn where await break".split()),
    "java": frozenset("package import static class interface enum record public private protected final abstract sealed non strictfp synchronized native transient volatile default if while for switch catch try else do finally case throws extends super return new throw instanceof break continue assert yield".split()),
    "c": frozenset("public private protected return if else for while do switch case struct enum union class namespace using template const static unsigned long signed short inline extern typedef virtual constexpr volatile auto new delete throw operator typename friend explicit sizeof goto default try catch break continue".split()),
}
_RUBY_WORDS = set("if unless while until and or not in then return rescue ensure else elsif when yield self nil true false super next break redo retry undef alias defined? raise require puts include extend private protected public module_function loop lambda proc".split())
_OPENERS = set("class module def begin case".split())
_MODIFIERS = set("if unless while until".split())


def family(ext: str) -> str:
    language = EXTENSIONS[ext]
    return {"typescript": "js", "tsx": "js", "javascript": "js", "jsx": "js", "cpp": "c"}.get(language, language)


def tokens(text: str, ext: str) -> tuple[list[str], list[bool], list[int]]:
    """Kinds, line-break marks and offsets of all tokens; what cannot be one is the kind BAD."""
    fam = family(ext)
    text = text.replace("\r\n", " \n").removeprefix("﻿")
    found = spans(text, EXTENSIONS[ext])
    tail = re.compile(r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_']*(?:\.(?![.\w])|\.[\d_]+)?(?:[eE][-+]?\d+)?|\.\d[\d_]*(?:[eE][-+]?\d+)?)" + _NUM_TAIL[fam] + r"(?!\w)" if fam != "go" else _NUM.pattern)
    ops = _PY_OP if fam == "python" else _OP
    names = _WORDS.get(fam, _WORD)
    keywords = _KEYWORDS.get(fam, frozenset())
    kinds: list[str] = []
    breaks: list[bool] = []
    places: list[int] = []
    state = {"broke": True, "directive": 0}

    def put(kind, at):
        kinds.append(kind)
        breaks.append(state["broke"])
        places.append(at)
        state["broke"] = False

    def plain(a, b):
        i = max(a, min(b, state["directive"]))
        while i < b:
            c = text[i]
            if c == "\n":
                state["broke"] = True
                if fam == "python":
                    kinds.append("\n")
                    breaks.append(False)
                    places.append(i)
                i += 1
            elif c.isspace():
                i += 1
            elif c == "\\" and fam in ("python", "c", "ruby") and re.match(r"\\[ \t]*\n", text[i : i + 3]):
                i = text.index("\n", i) + 1
            elif c == "#" and fam == "c":
                end = i  # a directive runs to the end of its line, continued lines included
                while True:
                    end = text.find("\n", end)
                    if end < 0 or text[end - 1] != "\\":
                        break
                    end += 1
                state["directive"] = len(text) if end < 0 else end
                i = min(state["directive"], b)
            elif c.isdigit() or (c == "." and text[i + 1 : i + 2].isdigit() and (not kinds or kinds[-1] not in ("ID", ")", "]"))):
                m = tail.match(text, i)
                if m and not (fam == "js" and re.match(r"0\d*[89]?\d", m.group()) and ext in (".mjs", ".mts")):
                    put("NUM", i)
                    i = m.end()
                else:
                    put("BAD", i)
                    i += 1
            elif m := names.match(text, i):
                w = m.group()
                i = m.end()
                if i > b:
                    i = b
                word(w, m.start())
            elif m := ops.match(text, i):
                x = m.group()
                if x == "'" or (x == "$" and fam not in ("ruby", "js")) or (x == "@" and fam in ("go", "c", "rust") and fam != "rust") or (x == "\\" and fam != "ruby") or (x == "#" and fam not in ("rust", "js")):
                    put("BAD", i)
                elif x == "**" and fam in ("c", "go", "rust"):
                    put("*", i)
                    put("*", i + 1)
                else:
                    put(x, i)
                i = m.end()
            elif fam == "rust" and (m := re.compile(r"'[^\W\d]\w*").match(text, i)):
                put("LIFE", i)
                i = m.end()
            elif fam == "ruby" and c in "`'\"":
                put("STR", i)
                i += 1
            else:
                put("BAD", i)
                i += 1

    def word(w, at):
        if fam == "python":
            put(w if w in _PY_WORDS else "ID", at)
            if w in _PY_SOFT:
                kinds[-1] = "SOFT:" + w
        elif fam == "js":
            put("KW:" + w if w in _JS_WORDS else "SOFT:" + w if w in _JS_SOFT else "ID", at)
        elif fam == "ruby":
            after_dot = kinds and kinds[-1] in (".", "?.", "::", ":", "&.") or text[at + len(w) : at + len(w) + 1] == ":" and text[at + len(w) + 1 : at + len(w) + 2] != ":"
            line = text[text.rfind("\n", 0, at) + 1 : at]
            if after_dot or (kinds and kinds[-1] == "OPEN" and text[places[-1] : places[-1] + 3] == "def"):
                put("ID", at)
            elif w in _OPENERS or (w in _MODIFIERS and (not line.strip() or line.rstrip().endswith(("=", "(", "[", ",", "|", "{", ";", "&&", "||", "then", "else")))) or (w == "for" and not line.strip()):
                put("OPEN", at)
            elif w == "do" and not re.match(r"\s*(?:while|until|for)\b", line):
                put("OPEN", at)
            else:
                put("end" if w == "end" else "WORD" if w in _RUBY_WORDS else "ID", at)
        else:
            put(w if w in keywords else "ID", at)

    at = 0
    for a, b, kind in found:
        plain(at, a)
        at = b
        piece = text[a:b]
        if kind == "c":
            if piece.startswith("/*") and (not piece.endswith("*/") or len(piece) < 4):
                put("BAD", a)
            state["broke"] = state["broke"] or "\n" in piece
        elif a < state["directive"]:
            continue
        elif kind == "s":
            m = re.match(r"(?:[bB]?[rRuUbBfF]{0,2}#*|R)?(\"\"\"|'''|\"|'|`)", piece)
            quote = m.group(1) if m else '"'
            if fam == "rust" and kinds and kinds[-1] == "ID" and text[places[-1] : a] in ("b", "r", "br", "c", "cr"):
                kinds.pop(), breaks.pop(), places.pop()  # the mark of a byte or raw string
            closed = len(piece) >= m.end() + len(quote) and piece.rstrip("#").endswith(quote) if m else False
            put("STR" if closed else "BAD", a)
        else:
            put("REGEX", a)
    plain(at, len(text))
    return kinds, breaks, places


def layout(kinds: list[str], places: list[int], text: str) -> tuple[list[str], list[int]]:
    """Python's logical lines: NL, INDENT and DEDENT in place of line breaks; uneven indentation gives BAD."""
    out, at, depth, levels, new = [], [], 0, [0], True
    for k, p in zip(kinds, places, strict=True):
        if k == "\n":
            if depth == 0 and not new:
                out.append("NL")
                at.append(p)
                new = True
            continue
        if new and depth == 0:
            row = text[text.rfind("\n", 0, p) + 1 : p]
            if row.strip() == "":
                width = len(row.expandtabs(8))
                if width > levels[-1]:
                    levels.append(width)
                    out.append("INDENT")
                    at.append(p)
                while width < levels[-1]:
                    levels.pop()
                    out.append("DEDENT" if width >= levels[-1] or len(levels) > 1 else "BAD")
                    at.append(p)
                if width != levels[-1]:
                    out.append("BAD")
                    at.append(p)
        new = False
        depth += (k in ("(", "[", "{")) - (k in (")", "]", "}"))
        out.append(k)
        at.append(p)
    if not new:
        out.append("NL")
        at.append(len(text))
    out += ["DEDENT"] * (len(levels) - 1)
    at += [len(text)] * (len(levels) - 1)
    return out, at


def _expand(grammar: str, words: set[str], soft: set[str], js: bool) -> str:
    """Soft keywords are names too: ID stands for all of them, and a quoted word for its kind."""
    grammar = re.sub(r"\bKW\b", "keyword", re.sub(r"\bID\b", "ident", grammar))
    grammar = re.sub(r"'([a-z]+)'", lambda m: "'SOFT:" + m.group(1) + "'" if m.group(1) in soft else "'KW:" + m.group(1) + "'" if js and m.group(1) in words else m.group(0), grammar)
    rules = "\nident <- ID / " + " / ".join(f"'SOFT:{w}'" for w in sorted(soft))
    return grammar.rstrip() + rules + ("\nkeyword <- " + " / ".join(f"'KW:{w}'" for w in sorted(words)) if js else "") + "\n"


_parsers: dict = {}


def parser(ext: str):
    kind = _KINDS.get(ext) or family(ext)
    if kind not in _parsers:
        if kind in ("js", "jsx", "ts", "tsx"):
            text = _expand(G.script(kind.startswith("ts"), kind.endswith("x")), _JS_WORDS, _JS_SOFT, True)
        elif kind == "python":
            text = _expand(G.PYTHON, set(), _PY_SOFT, False)
        else:
            text = {"go": G.GO, "rust": G.RUST, "java": G.JAVA, "c": G.C, "ruby": G.RUBY}[kind]
        _parsers[kind] = compiled(Grammar(text))
    return _parsers[kind]


def failure(text: str, ext: str) -> tuple[int, str] | None:
    """None if the whole text parses, else the line of the furthest position and the cause."""
    if not text.strip():
        return None
    kinds, breaks, places = tokens(text, ext)
    plain = text.replace("\r\n", " \n").removeprefix("﻿")
    if family(ext) == "python":
        kinds, places = layout(kinds, places, plain)
        breaks = [False] * len(kinds)
    sys.setrecursionlimit(200_000)
    good, far = parser(ext)(kinds, breaks)
    if good:
        return None
    at = places[far] if far < len(places) else len(plain)
    conflict = [m for m in _CONFLICT.finditer(plain)]
    cause = "conflict" if len(conflict) > 1 else "truncated" if far >= len(kinds) - 1 else "token" if kinds[far] == "BAD" else "syntax"
    return Lines(plain).of(min(at, max(0, len(plain) - 1))), cause


def checked(files: DataFrame, documents: DataFrame) -> DataFrame:
    """file_id, repo, language, line and cause (both null where the text parses) of each source file with a text.

    Texts are parsed where they lie, by the extension of the path that their own row names; only verdicts are shuffled.
    Files delivered again count once. Empty texts parse; null texts and unknown extensions give no row.
    """
    f = files.where(F.col("file_id").isNotNull() & is_source(F.col("repo_path"))).groupBy("file_id").agg(F.min(F.struct("ingested_at", "repo", "repo_path")).alias("r"))
    d = documents.where("kind = 'source' AND file_id IS NOT NULL AND text IS NOT NULL").where(is_source(F.col("repo_path")))

    def run(batches):
        for pdf in batches:
            out = []
            for fid, ext, text in pdf.itertuples(index=False):
                bad = failure(text, ext)
                out.append((fid, EXTENSIONS[ext], bad[0] if bad else None, bad[1] if bad else None))
            yield pd.DataFrame(out, columns=["file_id", "language", "line", "cause"]).astype({"line": "Int32"})

    told = spread(d.select("file_id", extension(F.col("repo_path")).alias("ext"), "text")).mapInPandas(run, "file_id long, language string, line int, cause string")
    told = told.groupBy("file_id").agg(F.min(F.struct("language", "line", "cause")).alias("t"))
    return f.join(told, "file_id").select("file_id", "r.repo", "t.language", "t.line", "t.cause")
