"""Symbols and import edges read out of source texts: table functions over Arrow batches, resolved by plan expressions.

A text is lexed once; declarations are found in it with comments and strings blanked out, so that code in strings is no
code. Texts are independent of each other, so neither function shuffles; a large repository is only more rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.lexing import FAMILY, Lines, body_end, masked, spans
from codeloom.langs import language
from codeloom.session import spread

SYMBOLS = "file_id long, language string, id string, name string, kind string, signature string, line_start int, line_end int, docstring string, parent_id string, visibility string, complexity int, symbol_ord int"
IMPORTS = "file_id long, target string, specifiers array<string>, edge_ord int"
#: Most characters of a signature and of a docstring.
SHOWN = 400

_N = r"(?P<n>[^\W\d][\w$]*)"
_EXPORT = r"^[ \t]*(?:export[ \t]+(?:default[ \t]+)?)?(?:declare[ \t]+)?"
_JAVA = r"(?:(?:public|private|protected|static|final|abstract|sealed|synchronized|native|default|strictfp)[ \t]+)*"
_DECLARED = {
    "js": [
        ("function", rf"{_EXPORT}(?:async[ \t]+)?function[ \t]*\*?[ \t]*{_N}"),
        ("class", rf"{_EXPORT}class[ \t]+{_N}"),
        ("interface", rf"{_EXPORT}interface[ \t]+{_N}"),
        ("type", rf"{_EXPORT}type[ \t]+{_N}[ \t]*(?:<[^=\n]*>)?[ \t]*="),
        ("enum", rf"{_EXPORT}(?:const[ \t]+)?enum[ \t]+{_N}"),
        ("method", rf"^[ \t]*(?:(?:public|private|protected|static|async|override|get|set)[ \t]+)*[*#]?(?!(?:if|for|while|switch|catch|function|return|with)\b){_N}[ \t]*(?:<[^>\n]*>)?(?=\()"),
    ],
    "python": [("function", rf"^[ \t]*(?:async[ \t]+)?def[ \t]+{_N}"), ("class", rf"^[ \t]*class[ \t]+{_N}")],
    "go": [
        ("method", rf"^func[ \t]*\([^)\n]*\)[ \t]*{_N}"),
        ("function", rf"^func[ \t]+{_N}"),
        ("class", rf"^type[ \t]+{_N}(?:\[[^\]\n]*\])?[ \t]+struct\b"),
        ("interface", rf"^type[ \t]+{_N}(?:\[[^\]\n]*\])?[ \t]+interface\b"),
    ],
    "rust": [
        ("function", rf"^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?(?:(?:const|async|unsafe|extern(?:[ \t]*\S+)?)[ \t]+)*fn[ \t]+{_N}"),
        ("class", rf"^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?struct[ \t]+{_N}"),
        ("enum", rf"^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?enum[ \t]+{_N}"),
        ("interface", rf"^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?(?:unsafe[ \t]+)?trait[ \t]+{_N}"),
        ("interface", rf"^[ \t]*(?:unsafe[ \t]+)?impl(?:<[^{{\n]*?>)?[ \t]+(?:\w+::)*{_N}(?:<[^{{\n]*>)?[ \t]+for\b"),
        ("impl", rf"^[ \t]*impl(?:<[^{{\n]*?>)?[ \t]+{_N}(?:<[^{{\n]*>)?[ \t\n]*(?:where\b[^{{]*)?(?=\{{)"),
    ],
    "java": [
        ("class", rf"^[ \t]*{_JAVA}class[ \t]+{_N}"),
        ("interface", rf"^[ \t]*{_JAVA}interface[ \t]+{_N}"),
        ("enum", rf"^[ \t]*{_JAVA}enum[ \t]+{_N}"),
        ("method", rf"^[ \t]*{_JAVA}(?:<[^>\n]*>[ \t]*)?(?!(?:return|new|throw|else|case|package|import|assert|class|enum|interface|record)\b)[A-Za-z_][\w.]*(?:<[^;(){{}}\n]*>)?(?:\[\])*[ \t]+{_N}[ \t]*(?=\()"),
    ],
    "c": [
        ("class", rf"^[ \t]*(?:template[ \t]*<[^\n]*>\s*)?(?:class|struct)[ \t]+{_N}[^;(){{}}=]*(?=\{{)"),
        ("function", rf"^[ \t]*(?!(?:return|else|new|delete|throw|case|typedef|using|goto|if|for|while|switch)\b)(?:[A-Za-z_][\w:]*(?:<[^;(){{}}\n]*>)?[ \t*&]+)+{_N}[ \t]*(?=\()"),
    ],
    "ruby": [("method", r"^[ \t]*def[ \t]+(?:self\.)?(?P<n>\w+[?!=]?)"), ("class", r"^[ \t]*class[ \t]+(?:\w+::)*(?P<n>[A-Z]\w*)"), ("module", r"^[ \t]*module[ \t]+(?:\w+::)*(?P<n>[A-Z]\w*)")],
}
_DECLARED = {k: [(kind, re.compile(p, re.M)) for kind, p in v] for k, v in _DECLARED.items()}
_NEEDS_BODY = {("js", "method"), ("c", "function")}
# Words that begin a branch, by family of languages.
_BRANCH = {
    "js": re.compile(r"\b(?:if|for|while|do|case|catch)\b"),
    "python": re.compile(r"\b(?:if|elif|else|for|while)\b"),
    "rust": re.compile(r"(?!)"),
    "ruby": re.compile(r"(?!)"),
}
_ANY_BRANCH = re.compile(r"\b(?:if|else|for|while|do|case|catch)\b")
_MARK = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*(?!/)|///?!?|#+)?[ \t]?|[ \t]*\*+/[ \t]*$", re.M)
_OPENS = re.compile(r"[()]")
# What may stand between the parameters and the body: qualifiers, a return type, a list of initializers.
_BODY = re.compile(r"\s*(?:(?:const|noexcept|override|final)\b\s*|:(?:[^;{}=]|\w\s*\{[^{}]*\}(?=\s*[,{]))*|->[^;{}]*)*\{")


def _closed(code: str, at: int) -> int:
    """Offset behind the bracket that closes the one at at; the end of the text if none does."""
    depth = 0
    for m in _OPENS.finditer(code, at):
        depth += 1 if m.group() == "(" else -1
        if depth == 0:
            return m.end()
    return len(code)


def first_paragraph(text: str) -> str | None:
    """The first paragraph of a comment without its marks, at most SHOWN characters; None where it is blank."""
    plain = _MARK.sub("", text).strip()
    plain = re.split(r"\n[ \t]*\n", plain)[0].strip()
    return (plain if len(plain) <= SHOWN else plain[:SHOWN] + "…") or None


def _above(text: str, comments: dict[int, tuple[int, int]], line: int) -> str | None:
    """The comment whose last line is the one above; a run of line comments is one."""
    parts = []
    while line - 1 in comments:
        a, b = comments[line - 1]
        parts.append(text[a:b])
        line = line - 1 - text.count("\n", a, b)
        if text.startswith("/*", a):
            break
    return first_paragraph("\n".join(reversed(parts))) if parts else None


def _line_above(text: str, at: int) -> str:
    """The last line before an offset that is neither blank nor only end."""
    while at > 0:
        begin = text.rfind("\n", 0, at)
        line = text[begin + 1 : at].strip()
        if line not in ("", "end"):
            return line
        at = begin
    return ""


def _visible(fam: str, name: str, node: str, exported: bool, before: str) -> str:
    if fam == "js":
        good = exported
    elif fam == "python":
        good = not name.startswith("_")
    elif fam == "go":
        good = name[0].isupper()
    elif fam == "rust":
        good = "pub " in node
    elif fam == "java":
        good = "public " in node
    elif fam == "c":
        good = not re.search(r"^[ \t]*static ", node, re.M) and "private:" not in before
    else:
        good = before not in ("private", "protected")
    return "public" if good else "internal"


def symbols_of(text: str, path: str, lang: str) -> list[tuple]:
    """Rows of SYMBOLS without file_id for one text, in order of their place."""
    fam = FAMILY[lang]
    text = text.replace("\r\n", "\n")
    found = spans(text, lang)
    code = masked(text, found)
    lines = Lines(text)
    comments = {lines.of(max(a, b - 1)): (a, b) for a, b, kind in found if kind == "c" and not text[lines.starts[lines.of(a) - 1] : a].strip()}
    strings = {a: b for a, b, kind in found if kind == "s"}
    begins = sorted(strings)
    nodes, taken = [], set()
    for kind, pattern in _DECLARED[fam]:
        for m in pattern.finditer(code):
            if m.start("n") in taken:
                continue
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            if (fam, kind) in _NEEDS_BODY and not _BODY.match(code, _closed(code, m.end())):
                continue
            taken.add(m.start("n"))
            end = body_end(code, start, lang, lines.starts)
            if fam == "rust" and kind == "function" and code[end - 1 : end] != "}":
                continue  # a signature of a trait
            nodes.append((start, start + len(code[start:end].rstrip()), kind, m.group("n")))
    nodes.sort(key=lambda x: (x[0], -x[1]))
    out, open_nodes = [], []
    for start, end, kind, name in nodes:
        while open_nodes and open_nodes[-1][1] <= start:
            open_nodes.pop()
        owner = next((x for x in reversed(open_nodes) if x[2] in ("class", "interface", "impl", "enum")), None)
        direct = open_nodes[-1] if open_nodes else None
        if kind == "method" and fam in ("js", "java") and (direct is None or direct[2] not in ("class", "interface", "enum")):
            continue
        if kind == "function" and owner and (fam == "python" or (direct is owner and (fam == "c" or (fam == "rust" and owner[4])))):
            kind = "method"
        if kind == "method" and fam == "ruby" and not any(x[2] in ("class", "module") for x in open_nodes):
            kind = "function"
        is_impl = fam == "rust" and code.startswith(("impl", "unsafe impl"), start)
        exported = code.startswith("export", start) or any(x[5] for x in open_nodes)
        open_nodes.append((start, end, kind, name, is_impl, exported))
        if kind == "impl":
            continue
        line = lines.of(start)
        node = text[start:end]
        doc = _above(text, comments, line)
        if doc is None and lang == "python":
            head = re.compile(r"[^\n]*?:[ \t]*\n\s*").match(code, _closed(code, code.find("(", start)) if kind != "class" else start)
            if head:
                at = next((a for a in range(head.end() - len(head.group().rsplit("\n", 1)[-1]), min(head.end() + 1, len(text))) if a in strings), None)
                if at is None and head.end() in strings:
                    at = head.end()
                at = at if at is not None else next((a for a in begins[bisect_left(begins, head.start()) : bisect_left(begins, head.end() + 1)] if not code[head.start() : a].split(":", 1)[-1].strip()), None)
                doc = first_paragraph(text[at : strings[at]].lstrip("rRuUbB").strip("\"'")) if at is not None else None
        parent = f"{path}::class.{owner[3]}" if kind == "method" and owner and fam in ("js", "python", "rust", "java", "c") else None
        signature = re.sub(r"\s+", " ", " ".join(node.split("\n", 2)[:2])).strip()[:SHOWN]
        seen = _visible(fam, name, node, exported, text[max(0, start - 250) : end] if fam == "c" else _line_above(text, start) if fam == "ruby" else "")
        branches = len(_BRANCH.get(fam, _ANY_BRANCH).findall(code, start, end))
        out.append((f"{path}::{kind}.{name}", name, kind, signature, line, lines.of(max(start, end - 1)), doc, parent, seen, 1 + branches, len(out)))
    return out


_IMPORT = {
    "js": re.compile(r"^[ \t]*(?P<k>import|export)\b[ \t]*(?:(?P<s>[\w$*\s{},]+?)\bfrom\s*)?[\"'](?P<t>[^\"'\n]+)[\"']", re.M),
    "python": re.compile(r"^[ \t]*(?:(?P<k>from)[ \t]+(?P<t>\.*[\w.]*)[ \t]+import[ \t]*(?P<s>\([^)]*\)|[^\n;#]+)|(?P<k2>import)[ \t]+(?P<t2>[\w.]+)(?![ \t]+as\b))", re.M),
    "go": re.compile(r"^[ \t]*(?P<k>import)[ \t]*(?:\((?P<block>[^)]*)\)|(?:[\w.]+[ \t]+)?\"(?P<t>[^\"\n]+)\")", re.M),
    "rust": re.compile(r"^[ \t]*(?P<k>use)[ \t]+(?P<t>[\w:]+?)(?:::\{(?P<s>[^{}]*)\})?[ \t]*;", re.M),
    "java": re.compile(r"^[ \t]*(?P<k>import)[ \t]+(?:static[ \t]+)?(?P<t>[\w.]+(?:\.\*)?)[ \t]*;", re.M),
    "c": re.compile(r"^[ \t]*(?P<k>#)[ \t]*include[ \t]*\"(?P<t>[^\"\n]+)\"", re.M),
    "ruby": re.compile(r"^[ \t]*(?P<k>require|require_relative|load)[ \t(]+[\"'](?P<t>[^\"'\n#]+)[\"']", re.M),
}


def _names(part: str | None) -> list[str]:
    """Imported names of a list such as a, b as c, type T."""
    words = [re.sub(r"\s+as\s+.*$", "", x.strip(), flags=re.S).removeprefix("type ").strip() for x in (part or "").strip("() \n").split(",")]
    return [w for w in words if w]


def imports_of(text: str, lang: str) -> list[tuple[str, list[str]]]:
    """(target as written, imported names) of every import, equal ones once, in order of their place."""
    fam = FAMILY[lang]
    text = text.replace("\r\n", "\n")
    found = spans(text, lang)
    code, kept = masked(text, found), masked(text, found, keep="s")
    out: dict[tuple, None] = {}
    for m in _IMPORT[fam].finditer(kept):
        group = m.groupdict()
        if code[m.start("k") if group["k"] else m.start("k2")] == " ":
            continue  # inside a string
        target, listed = group.get("t") or group.get("t2"), group.get("s")
        if fam == "go" and group["block"] is not None:
            out.update(dict.fromkeys((x, ()) for x in re.findall(r'"([^"\n]+)"', group["block"])))
            continue
        if not target or (fam == "js" and group["k"] == "export" and not listed):
            continue
        if fam == "js":
            inner = re.search(r"\{([^}]*)\}", listed or "")
            names = _names(inner.group(1)) if inner else []
        elif fam == "java":
            names = [] if target.endswith(".*") else [target.rsplit(".", 1)[-1]]
        else:
            names = _names(listed)
        out[(target, tuple(names))] = None
    return [(t, list(s)) for t, s in out]


def _sources(documents: DataFrame) -> DataFrame:
    rows = documents.where((F.col("kind") == "source") & F.col("file_id").isNotNull() & (F.length("text") > 0))
    rows = rows.select("file_id", "repo_path", language(F.col("repo_path")).alias("lang"), "text")
    return spread(rows.where(F.col("lang").isin(*FAMILY)))


def symbols(documents: DataFrame) -> DataFrame:
    """Rows of SYMBOLS of every source text. Null and empty texts and other languages give no rows; a text that
    stands in two rows gives its symbols twice; other columns are ignored."""

    def run(batches):
        for pdf in batches:
            rows = [(fid, lang, *r) for fid, path, lang, text in pdf.itertuples(index=False) for r in symbols_of(text, path, lang)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SYMBOLS.split(", ")])

    return _sources(documents).mapInPandas(run, SYMBOLS)


def resolved(importer: Column, target: Column, lang: Column) -> Column:
    """Path that an import points to, null where it leaves the root or the language has none; packages stay as written."""
    folder = F.slice(F.split(importer, "/"), 1, F.size(F.split(importer, "/")) - 1)
    dots = F.length(F.regexp_extract(target, r"^(\.*)", 1))
    dotted = F.split(F.regexp_replace(F.regexp_replace(target, r"^\.+", ""), r"\.", "/"), "/")
    up = F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0)).cast("int"))

    def walked(parts: Column) -> Column:
        step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))).otherwise(F.concat(acc, F.array(x)))
        return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")

    slashed = F.translate(target, ".", "/")
    java = F.concat(F.regexp_replace(slashed, r"\*$", ""), F.lit(".java"))
    relative = target.rlike(r"^(\.|/)")
    return (
        F.when(lang == "python", F.when(dots > 0, walked(F.concat(folder, up, dotted))).otherwise(slashed))
        .when(lang == "java", java)
        .when(lang.isin("ruby", "c", "cpp"), F.when(relative | lang.isin("c", "cpp"), walked(F.concat(folder, F.split(target, "/")))).otherwise(target))
        .when(relative, walked(F.concat(folder, F.split(target, "/"))))
        .otherwise(target)
    )


def imports(documents: DataFrame) -> DataFrame:
    """file_id, from_path, to_path, specifiers, is_relative, edge_ord of every import of every source text.

    Imports without a path inside the root are left out. Null and empty texts give no rows.
    """

    def run(batches):
        for pdf in batches:
            rows = [(fid, path, lang, t, s, n) for fid, path, lang, text in pdf.itertuples(index=False) for n, (t, s) in enumerate(imports_of(text, lang))]
            yield pd.DataFrame(rows, columns=["file_id", "from_path", "lang", "target", "specifiers", "edge_ord"])

    schema = "file_id long, from_path string, lang string, target string, specifiers array<string>, edge_ord int"
    raw = _sources(documents).mapInPandas(run, schema)
    named = F.col("target").rlike(r"^(\.|/)") | F.col("lang").isin("c", "cpp")
    to = resolved(F.col("from_path"), F.col("target"), F.col("lang")).alias("to_path")
    return raw.select("file_id", "from_path", to, "specifiers", named.alias("is_relative"), "edge_ord").where("to_path IS NOT NULL")
