"""The queries of the core and their SQL."""

from __future__ import annotations

from quillon.plans import curation, inference, integrity, io_queries, reference_checks, rsa, scalar_queries, selections

MODULES = (reference_checks, rsa, inference, curation, integrity, scalar_queries, io_queries, selections)
QUERIES: dict = {}
SQL: dict = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
