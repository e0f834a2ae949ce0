"""Catalogue of this subpackage: every operator's query and, where SQL states
it, the DuckDB oracle."""

from __future__ import annotations

from importlib import import_module

#: Modules that state ``QUERIES`` and ``ORACLE_SQL``.
MODULES = ("op1_secrets", "op2_chat", "op3_passages", "op4_licenses", "op5_mixing", "op6_quality", "op7_lines", "op8_benchmark", "op9_jaccard", "op10_urls",
           "op11_repair", "op12_negatives", "op13_kneser_ney")

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
