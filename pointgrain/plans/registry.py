"""All registered queries and the SQL that checks them, merged from the query modules."""

from __future__ import annotations

import importlib

MODULES = ("contracts", "views", "density", "compare", "sampling", "runs", "outcomes")

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"pointgrain.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
