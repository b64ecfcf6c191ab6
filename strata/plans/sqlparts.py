"""Reusable SQL fragments for the DuckDB oracles."""

from __future__ import annotations

from ..functions.dims import PY_WS_CLASS, SPLITLINES_RE, sql_values
from ..sources.tables import CODE_CORPUS_SQL, corpus_paths_sql

CC = f"cc AS ({CODE_CORPUS_SQL})"
CP = f"cp AS ({corpus_paths_sql()})"
WS = PY_WS_CLASS


def pystrip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def pylstrip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+', '', 'g')"


def l1(x: str) -> str:
    """splitlines() as a DuckDB list (drop the trailing empty piece)."""
    parts = f"string_split_regex({x}, '{SPLITLINES_RE}')"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[1:len({parts}) - 1] ELSE {parts} END)"


def values(rows, cols) -> str:
    return sql_values(rows, cols)
