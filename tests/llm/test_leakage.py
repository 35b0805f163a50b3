"""Planted passages of evaluation items (problem 7)."""

import pytest

from codeloom.llm.leakage import leaks

ITEM = "the quick brown fox jumps over a lazy dog while seven busy wizards mix potent jugs of liquid and forty zebras quietly watch them from behind the old wooden fence near the river bank"
W = ITEM.split()


@pytest.mark.parametrize("text,leaked", [
    ("before " + " ".join(W[5:25]) + " after", True),
    ("before " + " ".join(W[5:20]) + " after", False),
    ("\n# ".join(w.upper() for w in W[5:25]), True),
    (" ".join("<b class='" + "x" * 300 + f"'>{w}</b>&nbsp;" for w in W[5:25]), True),
    (" ".join("other" if n in (9, 18) else w for n, w in enumerate(W[2:26])), True),
    (" ".join("other" if n % 5 == 2 else w for n, w in enumerate(W)), False),
    (" ".join(W[3:8]) + " x y z " + " ".join(W[20:25]), False),
])
def test_planted_passages(spark, text, leaked):
    docs = spark.createDataFrame([(1, "nothing of it here " * 9), (2, text), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "s", ITEM), (8, "s", None), (9, "t", "too short")], "item_id long, suite string, text string")
    assert [tuple(r) for r in leaks(docs, items).collect()] == ([(2, 7)] if leaked else [])
