"""Configurations: JSON files of a folder, merged over defaults."""

from __future__ import annotations

import json
import os

from codeloom.functions.globs import DEFAULT_IGNORES

# The settings of an index unless told otherwise.
DEFAULTS = {
    "sourceRoots": ["."],
    "ignore": list(DEFAULT_IGNORES),
    "includeExtensions": [],
    "modules": {"rule": "by-directory", "alias": {}, "ignore": ["_tests", "_root"]},
    "budgets": {"file": 600, "symbol": 150, "module": 800, "architecture": 1200, "mermaidNodes": 30},
}


def merged(base: dict, over) -> dict:
    """base with the values of over: unknown keys are dropped, lists replaced, objects merged key by key."""
    if not isinstance(over, dict):
        return base
    return {k: merged(v, over[k]) if isinstance(v, dict) and isinstance(over.get(k), dict) else over.get(k, v) for k, v in base.items()}


def read_json(path: str):
    """The value of a JSON file; None where it is missing or not JSON."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


def load(folder: str, names: tuple[str, ...], package_key: str | None = None, defaults: dict = DEFAULTS) -> dict:
    """The first of the named files that holds JSON, else the value under package_key of package.json, over defaults."""
    for name in names:
        value = read_json(os.path.join(folder, name))
        if value is not None:
            return merged(defaults, value)
    package = read_json(os.path.join(folder, "package.json")) if package_key else None
    return merged(defaults, package.get(package_key)) if isinstance(package, dict) else merged(defaults, None)
