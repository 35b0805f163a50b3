"""Listings of folders, ignore rules, configurations, and the scalar rules of paths."""

import json
import re

import pytest
from pyspark.sql import functions as F

from codeloom.functions import globs, tokens
from codeloom.operators import catalog
from codeloom.session import checkpoint_dir
from codeloom.sources import settings
from codeloom.sources.walk import walk, with_text


def test_walk(spark, tmp_path):
    for name in ("a/b/__init__.py", "a/b/c/deep.go", "a/skip.log", "a/keep.log", "node_modules/x.js", "x/dist/y.js", "README.md", ".hidden/z.py", "gen/q.rs", "a/z.min.js"):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"text of {name}\r\n", newline="")
    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\n/gen/\n# no\n\n")
    df = walk(spark, str(tmp_path))
    rows = {r.repo_path: r for r in df.collect()}
    assert sorted(rows) == ["README.md", "a/b/__init__.py", "a/b/c/deep.go", "a/keep.log"]
    assert rows["a/b/c/deep.go"].language == "go" and rows["README.md"].language == "unknown"
    texts = {r.repo_path: r for r in with_text(df).collect()}
    assert texts["README.md"].text == "text of README.md\r\n" and len(texts["README.md"].content_hash) == 64
    assert [r.repo_path for r in walk(spark, str(tmp_path), max_files=2).collect()] == ["README.md", "a/b/__init__.py"]
    (tmp_path / "none").mkdir()
    assert walk(spark, str(tmp_path / "none")).count() == 0


def test_ignored_column_and_listing_agree(spark):
    paths = ["node_modules/a.js", "x/dist/b", "a.min.js", "x/yarn.lock", "src/a.js", "dist", "target/x/y.rs", "targets/x.rs", ".venv/lib/m.py", "a/Cargo.lock/b", "p/q.wasm"]
    found = globs.rules(globs.DEFAULT_IGNORES)
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", globs.ignored(F.col("p"), found).alias("i"))
    compiled = [(re.compile(r), i) for r, i in found]
    assert {r.p: r.i for r in df.collect()} == {p: globs.is_ignored(p, compiled) for p in paths}


def test_modules_and_test_paths(spark):
    want = {
        "src/a/b.ts": "src", "README.md": "README.md", "src/x.test.ts": "_tests", "spec/a.rb": "_tests", "test_utils/foo.py": "_tests", "pkg/foo_test.go": "_tests", "tests/helpers.ts": "tests",
        "a/__tests__/b.js": "_tests", "a/test.py": "a", "": "_root", "ui/forms/x.ts": "shared", "ui/form.ts": "ui",
    }
    df = spark.createDataFrame([(p,) for p in want], "p string").select("p", catalog.module(F.col("p"), (("ui/forms", "shared/forms"),)).alias("m"))
    assert {r.p: r.m for r in df.collect()} == want


def test_routes_and_summaries(spark):
    uris = {"wiki://tree?cursor=50": ("INDEX.md", 50), "wiki://architecture": ("architecture.md", 0), "wiki://symbol/a.py::function.f": ("symbols/a.py::function.f.md", 0), "http://x": (None, 0)}
    df = spark.createDataFrame([(u,) for u in uris], "u string").select("u", catalog.routed(F.col("u")).alias("p"), catalog.cursor(F.col("u")).alias("c"))
    assert {r.u: (r.p, r.c) for r in df.collect()} == uris
    answers = {'{"purpose": "P", "notes": "N"}': ("P", "N"), 'so: {"purpose":"P","notes":"N"} done': ("P", "N"), "Opens doors.\nTurns keys.\nOften.": ("Opens doors.", "Turns keys. Often."), "": ("", ""), '{"purpose": 1}': ('{"purpose": 1}', "")}
    p, n = catalog.summary_json(F.col("t"))
    got = {r.t: (r.p, r.n) for r in spark.createDataFrame([(t,) for t in answers], "t string").select("t", p.alias("p"), n.alias("n")).collect()}
    assert got == answers


def test_settings(tmp_path):
    assert settings.load(str(tmp_path), ("own.json",)) == settings.DEFAULTS
    (tmp_path / "package.json").write_text(json.dumps({"index": {"modules": {"ignore": []}, "other": 1}}))
    assert settings.load(str(tmp_path), ("own.json",), "index")["modules"] == {"rule": "by-directory", "alias": {}, "ignore": []}
    (tmp_path / "own.json").write_text('{"budgets": {"file": 7}, "ignore": ["x"]}')
    got = settings.load(str(tmp_path), ("own.json",), "index")
    assert got["budgets"]["file"] == 7 and got["budgets"]["symbol"] == 150 and got["ignore"] == ["x"] and "other" not in got


def test_token_prefix():
    e = tokens.encoding()
    count = lambda t: len(e.encode_ordinary(t))
    for text in ("lorem ipsum " * 200, "größe über alles 名前 " * 40, "x" * 3000):
        for budget in (1, 2, 10, 37):
            cut = tokens.prefix(text, budget)
            body = cut.removesuffix(" …")
            assert body == "" or (count(body) <= budget - 1 and text.startswith(body) and cut.endswith("…"))
            assert budget < 3 or all(count(text[:n]) > budget - 1 for n in range(len(body) + 2, min(len(text), len(body) + 60)) if text[:n].rstrip() != body)
    assert tokens.prefix("short", 10) == "short"


def test_signature_tokens_equal_the_joined_text(spark):
    rows = [(1, 1, 0, "def f(x):"), (1, 2, 1, "  class A { }"), (1, 3, 2, ""), (2, 4, 0, "fn ünï() -> u8 {")]
    symbols = spark.createDataFrame(rows, "file_id long, symbol_key long, symbol_ord int, signature string")
    files = spark.createDataFrame([(1, "a.py: 3 lines."), (2, None), (3, "")], "file_id long, summary string")
    got = {r.file_id: r.n_tokens for r in catalog.signature_tokens(symbols, files).collect()}
    e = tokens.encoding()
    joined = {1: "a.py: 3 lines.\ndef f(x):\n  class A { }\n", 2: "\nfn ünï() -> u8 {", 3: ""}
    assert got[2] == len(e.encode_ordinary(joined[2])) and got[3] == 0
    assert abs(got[1] - len(e.encode_ordinary(joined[1]))) <= 1  # a line that begins with blanks may join its line break


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError):
        checkpoint_dir(Session())
