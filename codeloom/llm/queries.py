"""All registered queries of the subpackage."""

from __future__ import annotations

import importlib

MODULES = ["q_docs", "q_leakage", "q_packing", "q_abuse", "q_provenance", "q_secrets", "q_syntax"]
_found = [importlib.import_module(f"codeloom.llm.{m}") for m in MODULES]
QUERIES = {k: v for m in _found for k, v in m.QUERIES.items()}
SQL = {k: v for m in _found for k, v in m.SQL.items()}
