"""Problem 1: generated, minified or vendored source files.

Three kinds of evidence, in this order: attribute files of the repository (for each attribute the last matching line of
the deepest folder wins), folder and file name patterns mined over all repositories, and what the text itself tells
(provenance_traits). A pattern is mined where nearly all of its files are declared or tell so themselves; it is applied
to the files without a declaration, as are bodies equal to those of known library files.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.globs import glob_regex
from codeloom.functions.lexing import masked, spans
from codeloom.functions.paths import normal_path
from codeloom.langs import is_source, language
from codeloom.llm.provenance_traits import traits
from codeloom.session import cut, small, spread

#: Least files and least share of decided ones of a mined pattern.
MINED_FILES, MINED_SHARE = 6, 0.8
#: Least characters of code of a body that identifies a library file.
BODY_CHARS = 80
# Attributes that declare a file as not written by hand.
_DECLARES = re.compile(r"^(-|!)?(linguist-generated|linguist-vendored|generated|vendored)(?:=(\w+))?$")


def attribute_rules(documents: DataFrame) -> DataFrame:
    """repo, folder, rules: of every folder with a .gitattributes file its lines as (attribute, regex, rank, value).

    Ranks order the lines of all files by precedence: deeper folders first, then later lines, then later words. value is
    true for a set attribute, false for an unset one and null for !attribute, which takes the declaration back. Files
    without repository or text give none. A folder's lines are those of one file, so no list grows with the repository.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for repo, path, text in zip(pdf["repo"], pdf["path"], pdf["text"], strict=True):
                folder = path.rpartition("/")[0]
                depth = folder.count("/") + bool(folder)
                for n, line in enumerate(text.split("\n")):
                    words = line.split()
                    if not words or words[0].startswith("#"):
                        continue
                    for k, w in enumerate(words[1:]):
                        m = _DECLARES.match(w)
                        if m:
                            value = None if m.group(1) == "!" else m.group(1) != "-" and m.group(3) not in ("false", "0")
                            out.append((repo, folder, m.group(2), glob_regex(words[0], folder), depth * 10**12 + n * 10**4 + min(k, 9999), value))
            yield pd.DataFrame(out, columns=["repo", "folder", "attribute", "regex", "rank", "value"]).astype({"value": "object"})

    d = documents.where("kind = 'source' AND text <> '' AND source IS NOT NULL AND repo_path RLIKE '(^|/)[.]gitattributes$'")
    schema = "repo string, folder string, attribute string, regex string, rank long, value boolean"
    rows = d.select(F.col("source").alias("repo"), normal_path(F.col("repo_path")).alias("path"), "text").mapInPandas(run, schema)
    return rows.groupBy("repo", "folder").agg(F.collect_set(F.struct("attribute", "regex", "rank", "value")).alias("rules"))


def declared(base: DataFrame, rules: DataFrame) -> DataFrame:
    """file_id and declared (true: generated or vendored, false: by hand) of the files of base that attribute files name.

    Each attribute is decided by itself: of its lines that match a file, the one of highest rank. A file is declared if
    any attribute is set, by hand if some are unset and none is set; attributes taken back say nothing. A file meets the
    rules of each of its folders as one row, not one per rule.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    at = base.select("file_id", "repo", "path", F.explode(folders).alias("folder"))
    hits = at.join(small(rules, 4096), ["repo", "folder"]).select("file_id", F.expr("inline(filter(rules, r -> path rlike r.regex))"))
    last = hits.groupBy("file_id", "attribute").agg(F.max(F.struct("rank", F.col("value").isNotNull().alias("said"), "value")).alias("m"))
    return last.where("m.value IS NOT NULL").groupBy("file_id").agg(F.bool_or("m.value").alias("declared"))


def examined(files: DataFrame, documents: DataFrame) -> DataFrame:
    """file_id, repo, path, own (what the text tells, '' for nothing) and body (hash of its code) of each source file.

    Texts are read where they lie, by the path that their own row names, and only what they tell is shuffled. Files
    delivered again count once; files without text or of no programming language give no row.
    """
    f = files.where(F.col("file_id").isNotNull() & is_source(F.col("repo_path"))).groupBy("file_id").agg(F.min(F.struct("ingested_at", "repo", "repo_path")).alias("r"))
    d = documents.where("kind = 'source' AND file_id IS NOT NULL AND text <> ''").where(is_source(F.col("repo_path")))

    def run(batches):
        for pdf in batches:
            out = []
            for fid, lang, text in pdf.itertuples(index=False):
                t = traits(text, lang)
                found = spans(text, lang)
                code = re.sub(r"\s+", " ", masked(text, [x for x in found if x[2] == "c"])).strip()
                out.append((fid, "+".join(k for k, v in t.items() if v), hashlib.md5(code.encode()).hexdigest() if len(code) >= BODY_CHARS else None))
            yield pd.DataFrame(out, columns=["file_id", "own", "body"])

    told = spread(d.select("file_id", language(F.col("repo_path")).alias("lang"), "text")).mapInPandas(run, "file_id long, own string, body string")
    told = told.groupBy("file_id").agg(F.min(F.struct("own", "body")).alias("t"))
    return f.join(told, "file_id").select("file_id", "r.repo", normal_path(F.col("r.repo_path")).alias("path"), "t.own", "t.body")


def patterns(path: str) -> F.Column:
    """Name patterns of a path: its folders, each folder with the ending of the next, and marks inside the file name."""
    parts = F.split(F.col(path), "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    follow = F.transform(F.sequence(F.lit(1), F.greatest(F.size(folders) - 1, F.lit(1))), lambda i: F.concat(F.get(folders, i - 1), F.lit("/*"), F.substring(F.get(folders, i), -2, 2)))
    mark = F.regexp_extract(F.element_at(parts, -1), r"([._][a-z0-9]{1,10})\.[^.]+$", 1)
    return F.array_distinct(F.filter(F.concat(F.transform(folders, lambda x: F.concat(x, F.lit("/"))), follow, F.array(F.concat(F.lit("*"), F.when(mark != "", mark)))), lambda x: x.isNotNull()))


def judged(files: DataFrame, documents: DataFrame) -> DataFrame:
    """file_id, repo, path and reason of each source file: declared, pattern (with the mined name pattern), own traits of
    the text, copy (of a known library file), or null for hand-written."""
    base = cut(examined(files, documents))
    known = base.join(declared(base, cut(attribute_rules(documents))), "file_id", "left").withColumn("sure", F.coalesce(F.col("declared"), F.col("own") != ""))
    bodies = known.where("sure AND own LIKE '%library%' AND body IS NOT NULL").select("body").distinct()
    # files without a body, of which there are many, meet no join on it
    copies = known.where("body IS NOT NULL AND declared IS NULL").select("file_id", "body").join(bodies, "body").select("file_id", F.lit(True).alias("copied"))
    known = known.join(copies, "file_id", "left").withColumn("copied", F.coalesce("copied", F.lit(False))).withColumn("sure", F.coalesce("declared", F.col("sure") | F.col("copied")))
    named = known.select("file_id", "sure", "declared", F.explode(patterns("path")).alias("pattern"))
    mined = cut(named.groupBy("pattern").agg(F.count("*").alias("n"), F.avg(F.col("sure").cast("int")).alias("share")).where((F.col("n") >= MINED_FILES) & (F.col("share") >= MINED_SHARE)).select("pattern"))
    by_name = named.where("declared IS NULL").join(small(mined, 512), "pattern").groupBy("file_id").agg(F.min("pattern").alias("pattern"))
    reason = F.when(F.col("declared"), "declared").when(F.col("declared").isNotNull(), None).when(F.col("pattern").isNotNull(), F.concat(F.lit("pattern "), "pattern")).when(F.col("own") != "", F.col("own")).when(F.col("copied"), "copy")
    return known.join(by_name, "file_id", "left").select("file_id", "repo", "path", reason.alias("reason"))
