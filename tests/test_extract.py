"""Symbols and imports of short texts, resolution of targets, streams of changes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from codeloom.operators import extract as x
from codeloom.operators import pages
from codeloom.streaming import changes

CASES = [
    ("ovens/bake.py", "python", "@timed\nasync def bake(tray: list[int] = (1, 2)) -> dict:\n    note = \"def no(): pass\"\n    return {}\n\nclass Oven(Base):\n    async def warm(self):\n        def inner():\n            pass\n    def _cool(self): pass\n",
     [("function", "bake", 2, 4, "public"), ("class", "Oven", 6, 10, "public"), ("method", "warm", 7, 9, "public"), ("method", "inner", 8, 9, "public"), ("method", "_cool", 10, 10, "internal")]),
    ("a.ts", "typescript", "// not: function no() {}\nexport class A {\n  put(x: {a: number}): void {\n    if (x) { call(x); }\n  }\n}\nfunction f() { return 1; }\nexport interface I { a: string }\n",
     [("class", "A", 2, 6, "public"), ("method", "put", 3, 5, "public"), ("function", "f", 7, 7, "internal"), ("interface", "I", 8, 8, "public")]),
    ("kiln.go", "go", "package kiln\n\ntype Shelf[K comparable] struct {\n\trows map[K]int\n}\n\ntype Filler interface{ Fill() }\n\nfunc (s *Shelf[K]) Stack(n int) (ok bool) {\n\treturn n > 0\n}\n\nfunc hidden() {\n}\n",
     [("class", "Shelf", 3, 5, "public"), ("interface", "Filler", 7, 7, "public"), ("method", "Stack", 9, 11, "public"), ("function", "hidden", 13, 14, "internal")]),
    ("a.rs", "rust", "pub fn open_it() {}\nfn shut() {}\npub trait Carry { fn lift(&self); }\nimpl Carry for Crate {\n  fn lift(&self) { }\n}\n",
     [("function", "open_it", 1, 1, "public"), ("function", "shut", 2, 2, "internal"), ("interface", "Carry", 3, 3, "public"), ("interface", "Carry", 4, 6, "internal"), ("method", "lift", 5, 5, "internal")]),
    ("Ferry.java", "java", "public final class Ferry {\n  enum Deck { UPPER, LOWER }\n  public <T> List<T> load(Map<String, T> in) { if (in == null) { return null; } return null; }\n  private void moor() {}\n}\n",
     [("class", "Ferry", 1, 5, "public"), ("enum", "Deck", 2, 2, "internal"), ("method", "load", 3, 3, "public"), ("method", "moor", 4, 4, "internal")]),
    ("tank.c", "c", "unsigned long fill_tank(const char *name, int litres) {\n  return litres;\n}\nstatic int drain(void) { return 0; }\nint declared_only(int a);\n",
     [("function", "fill_tank", 1, 3, "public"), ("function", "drain", 4, 4, "internal")]),
    ("dock.rb", "ruby", "module Dock\n  class Crane\n    def lift(load)\n      load.each do |x|\n        x\n      end\n    end\n  end\nend\n",
     [("module", "Dock", 1, 9, "public"), ("class", "Crane", 2, 8, "public"), ("method", "lift", 3, 7, "public")]),
]


@pytest.mark.parametrize("path,lang,text,want", CASES, ids=[c[1] for c in CASES])
def test_symbols(path, lang, text, want):
    assert [(r[2], r[1], r[4], r[5], r[8]) for r in x.symbols_of(text, path, lang)] == want


def test_docstring_parent_and_windows_line_ends():
    rows = x.symbols_of("// Adds two.\n// Fast.\nfunction add() {}\r\nclass B {\r\n  run() {\r\n  }\r\n}\r\n", "a.js", "javascript")
    assert [(r[1], r[6], r[7], r[4]) for r in rows] == [("add", "Adds two.\nFast.", None, 3), ("B", None, None, 4), ("run", None, "a.js::class.B", 5)]
    assert x.symbols_of("def f(a='x'):\n    \"\"\"Say it.\n\n    More.\n    \"\"\"\n", "a.py", "python")[0][6] == "Say it."


IMPORTS = [
    ("typescript", "import Main, { tray, warm as heat, type Shelf } from '../kiln/oven'\nimport './polyfill'\nexport default 'x'\nconst s = `\nimport q from 'no'\n`\n", [("../kiln/oven", ["tray", "warm", "Shelf"]), ("./polyfill", [])]),
    ("python", "from .shelf import (stack,\n    unstack)\nfrom ..yard import fill as f\nimport logging.handlers\n# import no\n", [(".shelf", ["stack", "unstack"]), ("..yard", ["fill"]), ("logging.handlers", [])]),
    ("go", 'package kiln\nimport (\n\t"strings"\n\ty "yard/crane"\n)\nimport "net/http"\n', [("strings", []), ("yard/crane", []), ("net/http", [])]),
    ("rust", "use std::rc::Rc;\nuse yard::{Crane, Hook};\n", [("std::rc::Rc", []), ("yard", ["Crane", "Hook"])]),
    ("java", "import org.yard.Crane;\nimport static org.yard.Hooks.*;\n", [("org.yard.Crane", ["Crane"]), ("org.yard.Hooks.*", [])]),
    ("cpp", '#include "yard/crane.h"\n#include <map>\n', [("yard/crane.h", [])]),
    ("ruby", "require_relative '../yard/crane'\nputs 'require \"no\"'\n", [("../yard/crane", [])]),
]


@pytest.mark.parametrize("lang,text,want", IMPORTS, ids=[c[0] for c in IMPORTS])
def test_imports(lang, text, want):
    assert x.imports_of(text, lang) == want


def test_resolution(spark):
    cases = [
        ("run.py", ".tray", "python", "tray"), ("yard/__init__.py", ".crane", "python", "yard/crane"), ("yard/__init__.py", "..kiln", "python", "kiln"),
        ("run.py", "..x", "python", None), ("run.py", "logging.handlers", "python", "logging/handlers"), ("a/b.ts", "../../x", "typescript", None), ("a/b.ts", "react", "typescript", "react"),
        ("web/kiln/index.ts", "../oven", "typescript", "web/oven"), ("A.java", "a.b.*", "java", "a/b/.java"), ("A.java", "a.B", "java", "a/B.java"), ("run.rb", "./crane", "ruby", "crane"), ("s/a.c", "b.h", "c", "s/b.h"),
    ]
    df = spark.createDataFrame(cases, "i string, t string, l string, want string")
    got = df.select("i", "t", x.resolved(F.col("i"), F.col("t"), F.col("l")).alias("got"), "want").collect()
    assert [(r.i, r.t, r.got) for r in got] == [(r.i, r.t, r.want) for r in got]


def test_null_and_empty_texts(spark):
    docs = spark.createDataFrame([("source", 1, "a.py", None, 1), ("source", 2, "a.py", "", 1), ("page", 3, "a.md", "def f(): pass", 1), ("source", None, "a.py", "def f(): pass", 1)], "kind string, file_id long, repo_path string, text string, lang int")
    assert x.symbols(docs).count() == 0 and x.imports(docs).count() == 0
    long = spark.createDataFrame([("source", 1, "a.py", "def f(): pass\n" * 20_000)], "kind string, file_id long, repo_path string, text string")
    assert x.imports(long).count() == 0 and x.symbols(long.withColumn("text", F.substring("text", 1, 14 * 500))).count() == 500


def test_bursts_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = spark.createDataFrame([("r", at(0), "a"), ("r", at(0.3), "b"), ("r", at(0.4), "a"), ("r", at(5), "c"), ("r", None, "d"), ("q", at(1), None)], "repo string, ts timestamp, path string")
    rows.write.parquet(str(tmp_path / "in"))
    args = ("repo", "ts", "500 milliseconds", "1 minute")
    want = sorted(map(str, changes.bursts(rows, *args).collect()))
    q = changes.bursts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), *args).writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("bursts").collect())) == want and len(want) == 3


def test_invalidation_is_kept_by_a_stream(spark, tmp_path):
    state = spark.createDataFrame([("r", "a", "h", False), ("r", "b", "k", None)], "repo string, repo_path string, hash string, public_signature_changed boolean")
    state.write.parquet(str(tmp_path / "s/version=-1"))
    seen = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", "new"), (None, "x")], "repo string, repo_path string")
    seen.coalesce(1).write.parquet(str(tmp_path / "in"))
    changes.keep_invalidated(spark.readStream.schema(seen.schema).parquet(str(tmp_path / "in")), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    rows = {r.repo_path: (r.hash, r.public_signature_changed) for r in spark.read.parquet(str(tmp_path / "s/version=0")).collect()}
    assert rows == {"a": ("h", True), "b": ("k", None), "new": (None, True)}


def test_yaml_and_cells(spark):
    r = spark.createDataFrame([('a"b\\c\nd', "x|y\nz"), (None, None)], "a string, b string").select(pages.yaml_string(F.col("a")).alias("a"), pages.cell(F.col("b"), 4).alias("b")).collect()
    assert [tuple(v) for v in r] == [('"a\\"b\\\\c\\nd"', "x\\|y"), ("null", "")]


def test_long_initializers_and_far_markers():
    wide = ", ".join(f"member_{i}(first_{i})" for i in range(40))
    text = "class Wide {\npublic:\n  Wide(int a) : " + wide + " {\n    go();\n  }\n  int plain() const {\n    return 1;\n  }\n};\n"
    assert len(wide) > 400
    assert {r[1] for r in x.symbols_of(text, "w.cpp", "cpp")} >= {"Wide", "plain"}
    ruby = "class A\n  private\n" + "\n" * 3000 + "  def far\n  end\nend\n"
    assert [r[8] for r in x.symbols_of(ruby, "a.rb", "ruby") if r[1] == "far"] == ["internal"]
