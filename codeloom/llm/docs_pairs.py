"""Problem 3: functions paired with their documentation.

Files are scanned once by the state machine of functions.lexing. Every comment whose last line stands directly above a
declaration, and every string that opens a Python body, gives one row (file, line of the declaration, text); rows and
symbols meet in a join on (file, line), so neither a hot file nor a hot repository is gathered anywhere.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.lexing import FAMILY, Lines, body_end, masked, spans
from codeloom.langs import language

_BETWEEN = re.compile(r"\s*(?:@[\w.]|#!?\[|\[\[|template\s*<)")
_DEF = re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+[^\W\d]\w*", re.M)
_STRING = re.compile(r"\s*((?:[rRuUbB]{0,2})(\"\"\"|'''|\"|'))")


def attached(text: str, lang: str) -> list[tuple[int, int, str, str]]:
    """(line of the declaration, offset behind its body, documentation, how) for all comments directly above something.

    A run of line comments is one comment. Lines of decorators, annotations and attributes may stand between, brackets
    that they open included; a blank line may not. how is 'above' or 'body'.
    """
    found = spans(text, lang)
    lines = Lines(text)
    starts = lines.starts
    code = masked(text, found)
    rows = code.split("\n")
    blocks: list[list] = []  # first line, last line, texts, is it a run of line comments
    for a, b, kind in found:
        if kind != "c":
            continue
        first, last = lines.of(a), lines.of(max(a, b - 1))
        if text[starts[first - 1] : a].strip() or rows[last - 1].strip():
            continue
        block = text.startswith("/*", a) or text.startswith("=begin", a)
        if blocks and not block and blocks[-1][3] and blocks[-1][1] == first - 1:
            blocks[-1][1] = last
            blocks[-1][2].append(text[a:b])
        else:
            blocks.append([first, last, [text[a:b]], not block])
    out = []
    for k, (_, last, texts, _) in enumerate(blocks):
        i = last  # index in rows of the line below
        while i < len(rows) and _BETWEEN.match(rows[i]):
            depth = 0
            while i < len(rows):
                depth += sum(rows[i].count(x) for x in "([") - sum(rows[i].count(x) for x in ")]")
                i += 1
                if depth <= 0:
                    break
        if i < len(rows) and rows[i].strip():
            out.append((i + 1, body_end(code, starts[i], lang, starts), "\n".join(texts), "above"))
    if lang == "python":
        string_at = {a: b for a, b, kind in found if kind == "s"}
        for m in _DEF.finditer(code):
            depth, at = 0, m.end()
            while at < len(code):
                x = code[at]
                depth += (x in "([{") - (x in ")]}")
                if x == ":" and depth <= 0:
                    break
                at += 1
            a = at + 1
            while a < len(code) and code[a].isspace() and a not in string_at:
                a += 1
            if a in string_at and text[a : string_at[a]].lstrip("rRuUbB")[:1] in ("'", '"') and "f" not in text[a : a + 2].lower():
                after = code[string_at[a] : code.find("\n", string_at[a]) if code.find("\n", string_at[a]) >= 0 else len(code)].strip()
                if not after or after.startswith(";"):
                    out.append((lines.of(m.end() - 1), body_end(code, m.start(), lang, starts), text[a : string_at[a]], "body"))
    return out


# Texts that describe nothing, as a whole line or as its beginning.
_PLACEHOLDER = re.compile(
    r"(?i)^(?:(?:to ?do|fix ?me|xxx|tbd|hack|wip|tba)\b.*|n/?a|none|null|nothing|undocumented|no (?:doc\w*|description)|see above|see below|ditto|same as above|"
    r"description|summary|documentation|docstring|comment|placeholder|auto-?generated (?:method|function|constructor)? ?stub|\W*)[.:!\s]*$"
)
_DIRECTIVE = re.compile(
    r"(?i)^(?:noqa\b|eslint\b|eslint-|tslint:|jshint\b|prettier-|pylint:|mypy:|type: *ignore|nolint\b|nosec\b|@ts-|ts-ignore|rubocop:|clang-|clang-format|istanbul |c8 |coverage:|"
    r"pragma\b|go:|\+build|region\b|endregion\b|#?region\b|#?endregion\b|fmt: *(?:on|off)|isort:|yapf:|flake8:|sorbet:|typed:|frozen_string_literal|-\*-|vim:|@?\{?@?inherit-?doc\}?|"
    r"@?generated\b|stylelint|biome-ignore|deno-lint|swagger:|allow\()"
)
_LICENCE_LINE = re.compile(r"(?i)^(?:[\w.-]+ v?\d+\.\d+\.\d+\b.*|spdx-license-identifier\b.*|\(c\) .*|.* - vendored copy\b.*)$")
_LICENCE = re.compile(r"(?i)(?:copyright|©)\s[^.]*(?:\.|$)|licensed under [^.]*(?:\.|$)|released under [^.]*licen[cs]e\.?|all rights reserved\.?|permission is hereby granted[^.]*\.?|this program is free software[^.]*\.?")
_TOOL = re.compile(r"(?i)do not (?:edit|modify)|auto-?generated|code generated by|generated by|output of \w+ --|erzeugt|produit par|changes will be lost")
_CODE = re.compile(
    r"^(?:[\w.\[\]$@>-]+\s*(?:[-+*/|&]?=|:=|\+\+|--)\s*\S.*|(?:return|throw|raise|import|from|include|require|const|let|var|if|for|while|else|elif|try|switch|case|def|fn|func|function|class|public|private|print\w*)\b.*[;({})\]:=].*|[\w.$:>-]+\([^)]*\)[;.]?|[{}()\[\];,]+|.*[;{}])$"
)
_TAG = re.compile(r"^(?:[@\\](?:\w+)|:(?:\w+)(?:\s+[\w.*]+)?:)\s*")
_PARAMETER = re.compile(r"^(?:[@\\](?:param|arg|argument|property|prop|tparam|typeparam|throws|exception|raises)\b|:(?:param|type|raises|arg)\b)")
_WORD = re.compile(r"[^\W_]+")
# Words that add nothing to a name.
_STOP = frozenset("a an the this that it its of to in for from with and or by on is are be method function procedure func def class member helper routine implementation impl getter setter does do performs".split())


def _split_name(name: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name or "")}


def _stem(word: str) -> str:
    for tail in ("ies", "ing", "ed", "es", "s", "d", "e", "y"):
        if word.endswith(tail) and len(word) - len(tail) >= 3:
            word = word[: -len(tail)]
            break
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word


def prose(comment: str) -> str:
    """The lines of a comment or docstring that describe something, without marks; '' if there are none."""
    text = comment.replace("\r", "")
    body = _STRING.match(text)
    if body and not text.startswith(("/", "#")):
        quote = body.group(2)
        text = text[body.end() :]
        text = text[: -len(quote)] if text.endswith(quote) else text
    lines = []
    for line in text.split("\n"):
        line = re.sub(r"^\s*(?:/\*+!?|\*+/|\*+(?!\*)|//+!?|#+(?!\w*region|\[)|=begin|=end)?", "", re.sub(r"\s*\*+/\s*$", "", line)).strip()
        lines.append(line)
    kept = []
    for line in _licence_free(lines).split("\n"):
        line = line.strip()
        if not line or _TOOL.search(line):
            continue
        bare = line.strip("-=*#~_+/<>|.! \t")
        if not bare or _DIRECTIVE.match(line) or _DIRECTIVE.match(bare) or re.match(r"[-=*#~_+]{3,}", line) or _PLACEHOLDER.match(bare) or _CODE.match(line):
            continue
        if _TAG.match(line):
            rest = _TAG.sub("", line)
            rest = re.sub(r"^[\w.\[\]*$]+\s*[-:]?\s*", "", rest) if _PARAMETER.match(line) and line[0] != ":" else rest
            if len(_WORD.findall(re.sub(r"\{[^}]*\}", " ", rest))) < 2:
                continue
            line = rest
        kept.append(line)
    return " ".join(kept)


def _licence_free(lines: list[str]) -> str:
    """Licence sentences may run over a line break: they are cut from each paragraph's joined text."""
    out, paragraph = [], []
    for line in [*(x for x in lines if not _LICENCE_LINE.match(x)), ""]:
        if line:
            paragraph.append(line)
            continue
        joined = " ".join(paragraph)
        out.append("\n".join(paragraph) if not _LICENCE.search(joined) else _LICENCE.sub(" ", joined))
        paragraph = []
    return "\n".join(out)


def described(comment: str, name: str) -> str:
    """The prose of a comment, or '' where it says no more than the words of the name."""
    text = prose(comment)
    own = {_stem(w) for w in _split_name(name)}
    new = [w for w in (x.lower() for x in _WORD.findall(text)) if w not in _STOP and _stem(w) not in own and not w.isdigit() and w != (name or "").lower()]
    return text if len(new) >= 2 else ""


DOC_SCHEMA = "file_id long, line int, comment string, how string, code string"


def documentation(documents: DataFrame, with_code: bool = False) -> DataFrame:
    """(file_id, line, comment, how, code) of every comment attached to a line of a source file, and of every docstring.

    documents: kind, file_id, repo_path, text; other columns are ignored. Null or empty texts and files of other
    languages give no rows; the same text delivered twice gives its rows twice.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for fid, lang, text in zip(pdf["file_id"], pdf["language"], pdf["text"], strict=True):
                for line, end, comment, how in attached(text, lang):
                    start = 0
                    if with_code:
                        start = Lines(text).starts[line - 1]
                    out.append((fid, line, comment, how, text[start:end] if with_code else None))
            yield pd.DataFrame(out, columns=["file_id", "line", "comment", "how", "code"])

    rows = documents.where((F.col("kind") == "source") & F.col("file_id").isNotNull() & (F.length("text") > 0))
    rows = rows.select("file_id", language(F.col("repo_path")).alias("language"), "text").where(F.col("language").isin(*FAMILY))
    return rows.mapInPandas(run, DOC_SCHEMA)


def described_udf(comment: Column, name: Column) -> Column:
    """Real description in a comment for a function of that name; '' if there is none. Null comments give ''."""

    @F.pandas_udf(T.StringType())
    def run(comments: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([described(c, n) if isinstance(c, str) else "" for c, n in zip(comments, names, strict=True)], dtype=object)

    return run(comment, name)


def pairs(symbols: DataFrame, documents: DataFrame, with_code: bool = True) -> DataFrame:
    """One row per function or method (symbol_key) with a real description: symbol_key, name, kind, description, code.

    Both a comment above and a string in the body may describe a symbol: the longer one is kept. Symbols delivered
    again count once, by their first delivery. Null keys, files and lines give no rows.
    """
    s = symbols.where(F.col("kind").isin("function", "method") & F.col("symbol_key").isNotNull())
    s = s.select("symbol_key", F.struct("ingested_at", "file_id", "line_start", "name", "kind").alias("r"))
    s = s.groupBy("symbol_key").agg(F.min("r").alias("r")).select("symbol_key", "r.file_id", F.col("r.line_start").alias("line"), "r.name", "r.kind")
    both = s.join(documentation(documents, with_code), ["file_id", "line"]).withColumn("description", described_udf(F.col("comment"), F.col("name")))
    best = F.max(F.struct(F.length("description"), "description", "code", "name", "kind")).alias("b")
    return both.where("description <> ''").groupBy("symbol_key").agg(best).select("symbol_key", "b.name", "b.kind", "b.description", "b.code")
