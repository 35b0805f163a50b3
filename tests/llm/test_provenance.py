"""What a text tells about who wrote it (problem 1)."""

import pytest
from pyspark.sql import functions as F

from codeloom.llm.provenance import judged
from codeloom.llm.provenance_traits import traits

LICENCE = "".join(f"// Licensed under the terms of line {i} of the licence.\n" for i in range(14))
CODE = "export function pick(a) {\n  return a.first;\n}\n"


@pytest.mark.parametrize("text", [
    LICENCE + "// Code generated by needlegen. DO NOT EDIT.\n" + CODE,
    CODE + "// Code generated by needlegen. DO NOT EDIT.\n",
    CODE.rstrip() + " // Code generated by needlegen. DO NOT EDIT.",
    CODE + "\n/* Made for the shop.\n * This file was automatically\n * generated by needlegen. */\n",
])
def test_banner_anywhere_in_header_or_end(text):
    assert traits(text, "javascript")["banner"]


def test_library_line_behind_a_long_header_or_at_the_end():
    line = "// vendored copy of leftpad\n"
    assert traits(LICENCE + line + CODE, "javascript")["library"] and traits(CODE + line, "javascript")["library"]


@pytest.mark.parametrize("text", [
    CODE + "// Code generated by needlegen once, since then edited by hand.\n",
    "const a = 1;\nconst b = 2;\n// Code generated by needlegen is read here.\n" + CODE,
    CODE + 'const text = "Code generated by needlegen. DO NOT EDIT.";\n',
])
def test_no_banner(text):
    assert not traits(text, "javascript")["banner"]


HAND = "export function pick(a) {\n  // takes the first\n  return a.first;\n}\n"
RULES = {
    ".gitattributes": "# c\n*.js linguist-generated\nown.js -linguist-generated\nback.js !linguist-generated\n*.js -linguist-vendored\nboth.js linguist-vendored linguist-generated=false\nlib/** linguist-vendored=true\n",
    "web/.gitattributes": "*.js linguist-generated=false\n",
}
WANT = {"a.js": "declared", "own.js": None, "back.js": None, "both.js": "declared", "x/y/b.js": "declared", "lib/q.ts": "declared", "web/c.js": None, "web/d/e.js": None, "free.ts": None}


def test_declarations_by_attribute_and_folder(spark):
    texts = {**dict.fromkeys(WANT, HAND), **RULES}
    rows = [(i, "r", p, t) for i, (p, t) in enumerate(texts.items())] + [(100 + i, "other", p, HAND) for i, p in enumerate(WANT)]
    docs = spark.createDataFrame([("source", r, i, p, t) for i, r, p, t in rows], "kind string, source string, file_id long, repo_path string, text string")
    files = spark.createDataFrame([(i, r, p) for i, r, p, _ in rows], "file_id long, repo string, repo_path string").withColumn("ingested_at", F.current_timestamp())
    got = {(r.repo, r.path): r.reason for r in judged(files, docs).collect()}
    assert got == {**{("r", p): w for p, w in WANT.items()}, **{("other", p): None for p in WANT}}


def test_mined_patterns_reach_files_that_tell_nothing(spark):
    told = "// Code generated by needlegen. DO NOT EDIT.\n" + HAND
    rows = [(i, f"r{i % 3}", f"src/m{i}.pb.js", told if i else HAND) for i in range(12)] + [(50 + i, f"r{i % 3}", f"src/m{i}.js", HAND) for i in range(12)]
    docs = spark.createDataFrame([("source", r, i, p, t) for i, r, p, t in rows], "kind string, source string, file_id long, repo_path string, text string")
    files = spark.createDataFrame([(i, r, p) for i, r, p, _ in rows], "file_id long, repo string, repo_path string").withColumn("ingested_at", F.current_timestamp())
    got = {r.file_id: r.reason for r in judged(files, docs).collect()}
    assert all(got[i] == "pattern *.pb" for i in range(12)) and not any(got[50 + i] for i in range(12))


def test_only_texts_of_a_fixed_turn_are_unrolled():
    message = "class M {\n" + "".join(f"  getA{i}() {{ return this.f{i}_ }}\n  setA{i}(v) {{ this.f{i}_ = v }}\n" for i in range(8)) + "}\n"
    by_hand = "".join(f"export function f{i}(a) {{\n  if (!a) {{\n    return null\n  }}\n" + "  go(a)\n" * (i % 3) + "  return a\n}\n" for i in range(8))
    table = "const T = {\n" + "".join(f"  k{i}: w(),\n" for i in range(30)) + "}\n"
    assert traits(message, "javascript")["unrolled"]
    assert not traits(by_hand, "javascript")["unrolled"] and not traits(table, "javascript")["unrolled"]
