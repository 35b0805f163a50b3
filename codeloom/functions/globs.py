"""Ignore patterns of repositories as regular expressions, for plan expressions and for file listings alike."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths that an index never holds unless told otherwise.
DEFAULT_IGNORES = (
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/.next/**", "**/.turbo/**", "**/coverage/**", "**/target/**", "**/__pycache__/**", "**/.venv/**", "**/venv/**",
    "**/*.min.js", "**/*.lock", "**/package-lock.json", "**/yarn.lock", "**/pnpm-lock.yaml", "**/Cargo.lock", "**/*.wasm",
)


def glob_regex(pattern: str, folder: str = "") -> str:
    """Regular expression over whole paths for one pattern that stands in a folder ('' for the root).

    * and ? stay inside a segment, ** crosses them, a pattern with a slash before its end is anchored at the folder, and
    whatever matches also stands for all below it. A slash at the end means folders only.
    """
    anchored = "/" in pattern.rstrip("/")
    p = pattern.strip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.+", i + 3
        elif p[i] == "*":
            run = len(p[i:]) - len(p[i:].lstrip("*"))
            out, i = out + "[^/]*", i + run
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            end = p.index("]", i + 2)
            out, i = out + "[" + p[i + 1 : end].replace("\\", "\\\\").replace("!", "^", 1) + "]", end + 1
        elif p[i] == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        else:
            out, i = out + re.escape(p[i]), i + 1
    base = re.escape(folder) + "/" if folder else ""
    return "^" + base + ("" if anchored else "(?:[^/]+/)*") + out + ("/.+" if pattern.endswith("/") else "(?:/.+)?") + "$"


def rules(lines: list[str] | tuple[str, ...], folder: str = "") -> list[tuple[str, bool]]:
    """(regex, ignores) of the lines of an ignore file; blank lines and comments give none, ! takes back."""
    out = []
    for line in lines:
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if line and not line.startswith("#"):
            out.append((glob_regex(line.removeprefix("!"), folder), not line.startswith("!")))
    return out


def ignored(path: Column, found: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that matches a path ignores it; null paths are ignored."""
    out = F.lit(False)
    for regex, ignores in found:
        out = F.when(path.rlike(regex), F.lit(ignores)).otherwise(out)
    return F.coalesce(out, F.lit(False)) | path.isNull()


def is_ignored(path: str, found: list[tuple[re.Pattern, bool]]) -> bool:
    """The same for one path of a listing; a taken-back path below an ignored folder stays ignored."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        at = "/".join(parts[:n]) + ("/" if n < len(parts) else "")
        last = next((i for r, i in reversed(found) if r.match(at.rstrip("/")) or (n < len(parts) and r.match(at + "x"))), False)
        if last:
            return True
    return False
