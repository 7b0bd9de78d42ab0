"""The package's registered queries and SQL."""

from __future__ import annotations

import importlib

MODULES = ("sharding", "mixing", "decontamination", "simhash", "toxicity", "quality", "pii", "language_model", "url_filter", "token_counts", "vector_codes", "hard_negatives", "hyperminhash")

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"pointgrain.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
