"""Registry of named queries and their independent SQL oracles.

``@query(name, oracle=SQL)`` registers ``fn(spark, sf_dir) -> DataFrame``.
The SQL runs in DuckDB over the same parquet tables (views named after the
tables); it is written on its own (recursive CTEs, list functions, plain
joins) rather than derived from the Spark plan.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
KIND: dict[str, str] = {}  # 'S' exact SQL, 'R' recursive SQL, 'P' no SQL (Python check in tests)


def query(name: str, oracle: str | None = None, kind: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            from ..session import ship_package
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        KIND[name] = kind or ("S" if oracle is not None else "P")
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (q_langs, q_rules, q_chunks, q_cache, q_verdicts, q_consensus,  # noqa: F401
                   q_scoring, q_diffs, q_vectors, q_sinks, q_stream)
