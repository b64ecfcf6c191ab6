"""Column expressions for the three line models and Python-style stripping.

L1 (``splitlines``): universal newlines, no trailing empty line.
L2 (``split('\\n')``): trailing empty line kept.
L3 (``readlines``): lines keep their newline.

All are JVM-side expressions (regex split + higher-order functions), so they
stay inside whole-stage code generation and never leave the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import OTHER_BREAKS_RE, PY_WS_CHARS, SPLITLINES_RE


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines_l1(text) -> Column:
    """``str.splitlines()``: split on every line break, drop a trailing empty piece.
    Texts with no break other than ``\\n`` take the plain ``split('\\n')`` path."""
    t = _col(text)
    parts = F.when(t.rlike(OTHER_BREAKS_RE), F.split(t, SPLITLINES_RE, -1)).otherwise(F.split(t, "\n", -1))
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines_l2(text) -> Column:
    """``str.split('\\n')``: keeps the trailing empty line; '' gives ['']."""
    return F.split(_col(text), "\n", -1)


def lines_l3(text) -> Column:
    """``readlines()``: lines with their newline kept; no empty last piece."""
    l2 = lines_l2(text)
    n = F.size(l2)
    with_nl = F.transform(l2, lambda x, i: F.when(i < n - 1, F.concat(x, F.lit("\n"))).otherwise(x))
    return F.filter(with_nl, lambda x: x != "")


def py_strip(c) -> Column:
    """Python ``str.strip()``: ``btrim`` over the exact whitespace set
    (plain ``trim`` only removes spaces); no regex."""
    return F.btrim(_col(c), F.lit(PY_WS_CHARS))


def py_lstrip(c) -> Column:
    return F.ltrim(_col(c), F.lit(PY_WS_CHARS))


def indent_of(c) -> Column:
    """``len(line) - len(line.lstrip())``."""
    return F.length(_col(c)) - F.length(py_lstrip(c))


def normalize_text(text) -> Column:
    """Strip every line, drop blank ones, join with '\\n' (P6)."""
    stripped = F.transform(lines_l1(py_strip(text)), lambda x: py_strip(x))
    return F.array_join(F.filter(stripped, lambda x: x != ""), "\n")


def base_name(path) -> Column:
    return F.regexp_extract(_col(path), r"[^/]*$", 0)


def ext_of(name) -> Column:
    """``os.path.splitext`` extension of a base name: the last dot with some
    non-dot character before it; '' otherwise."""
    return F.regexp_extract(_col(name), r"[^.].*(\.[^.]*)$", 1)


def explode_rows(df, keys, array_col: str, alias: str):
    """``explode`` for computed arrays: ``explode_outer`` + a not-null filter
    on the generated column. (A plain ``explode`` makes the optimizer infer
    ``size(array) > 0`` and push it below the projections, re-inlining the
    whole array expression.)"""
    return (df.select(*keys, F.explode_outer(array_col).alias(alias))
            .filter(F.col(alias).isNotNull()))
