"""Query catalogue: every implemented operator registered with a callable
``(spark, sf_dir) -> DataFrame`` and, where SQL can state it, the DuckDB
oracle over the same driver tables.

Conventions shared with the oracle: computed columns carry the same alias on
both sides, doubles are quantized with ``floor(x*1e6+0.5)/1e6``, integer
counts are BIGINT, arrays are returned joined into strings.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (eval_queries, feature_queries, io_queries, model_queries,  # noqa: F401
                   prep_queries, stream_queries, text_queries)
