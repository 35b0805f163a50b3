"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.langs import EXTENSIONS


def normal_path(path: Column) -> Column:
    r"""One spelling per path: \ becomes /, repeated / are merged, leading ./ and a trailing / are dropped."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), "/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(p, r"^(\./)+", ""), "/$", "")


def blank(value: Column) -> Column:
    return value.isNull() | (F.regexp_replace(value, r"\s+", "") == "")


# Extensions that an import may write for a source file of another extension.
WRITTEN_FOR = (".js", ".jsx", ".mjs", ".cjs")


def import_names(path: Column) -> Column:
    """All normalised import targets that the file at path answers to: the path itself, without its source
    extension, its folder if it is an index or __init__ file, and with a JavaScript extension instead of its own."""
    ext = F.regexp_extract(path, r"(\.[a-z]+)$", 1)
    source = ext.isin(*EXTENSIONS)
    stem = F.regexp_replace(path, r"\.[a-z]+$", "")
    folder = F.regexp_extract(stem, r"^(.*)/(?:index|__init__)$", 1)
    whole = stem.isin("index", "__init__")
    names = F.when(
        source,
        F.concat(
            F.array(path, stem),
            F.when(stem.rlike(r"/(?:index|__init__)$"), F.array(folder)).when(whole, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")),
            F.array(*[F.concat(stem, F.lit(e)) for e in WRITTEN_FOR]),
        ),
    ).otherwise(F.array(path))
    return F.array_distinct(names)
