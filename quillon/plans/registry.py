"""All registered queries: each module of operators lists its own, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib

#: Modules with ``QUERIES`` (name to function of session and folder) and ``ORACLES`` (name to DuckDB SQL).
MODULES: list[str] = ["retrieval", "evaluation", "texts", "history", "signals", "markup", "audit", "models"]


def _gathered(kind: str) -> dict:
    found: dict = {}
    for m in MODULES:
        found |= getattr(importlib.import_module(f"quillon.plans.{m}"), kind)
    return found


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict:
    return _gathered("ORACLES")
