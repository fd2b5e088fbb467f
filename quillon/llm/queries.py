"""All queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("selection", "vectors", "tokens", "language")
QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    try:
        _module = importlib.import_module(f"quillon.llm.{_name}")
    except ModuleNotFoundError as e:
        if e.name != f"quillon.llm.{_name}":
            raise
        continue
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
