"""Languages by file extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 21 source extensions and their languages.
EXTENSIONS = {
    ".ts": "typescript",
    ".mts": "typescript",
    ".cts": "typescript",
    ".tsx": "tsx",
    ".js": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".jsx": "jsx",
    ".py": "python",
    ".pyi": "python",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".hh": "cpp",
    ".rb": "ruby",
}


def extension(path: Column) -> Column:
    """Lower-cased last extension with its dot; '' for none and for dot-files such as .bashrc."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(base, r"^.+?(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    """Language of a path by its extension, 'unknown' where the extension maps to none; null for null."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.when(path.isNotNull(), F.coalesce(F.try_element_at(known, extension(path)), F.lit("unknown")))


def is_source(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)
