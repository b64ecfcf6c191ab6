"""Fix-quality scoring of critical-CWE verdicts.

Every check is a column expression over the verdict row; the per-CWE lists
are small fixed dimensions, so each becomes a CASE over literal patterns
(regexes compiled once per task), not a join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dims import BLACKLIST, CRITICAL_CWE, CWE_KEYWORDS, SAFE_PATTERNS, TEST_MARKERS, WHITELIST
from ..functions.lines import lines_l1


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _any(cwe: Column, table: dict, test) -> Column:
    """OR of ``test(item)`` over the CWE's list; False for CWEs without one."""
    expr = None
    for k, items in table.items():
        cond = None
        for it in items:
            t = test(it)
            cond = t if cond is None else (cond | t)
        expr = F.when(cwe == k, cond) if expr is None else expr.when(cwe == k, cond)
    return expr.otherwise(F.lit(False))


def score_fix(cwe, vuln_type, lines, fix) -> Column:
    """struct of the checks, confidence, valid and verified for one verdict.

    ``lines`` is array<struct<lineNum, lineCode>>; ``fix`` the fixed code."""
    cwe, vt, fix = _c(cwe), F.lower(F.coalesce(_c(vuln_type), F.lit(""))), F.coalesce(_c(fix), F.lit(""))
    critical = cwe.isin(*CRITICAL_CWE)
    kw = None
    for k, words in CWE_KEYWORDS.items():
        cond = None
        for w in words:
            cond = vt.contains(w) if cond is None else (cond & vt.contains(w))
        kw = F.when(cwe == k, cond) if kw is None else kw.when(cwe == k, cond)
    keywords_ok = kw.otherwise(F.lit(True))
    safe_ok = _any(cwe, SAFE_PATTERNS, lambda p: fix.rlike("(?i)" + p))
    fix_lines = lines_l1(fix)
    orig_lines = lines_l1(F.array_join(F.transform(F.coalesce(_c(lines), F.array().cast("array<struct<lineNum:int,lineCode:string>>")),
                                                   lambda l: l["lineCode"]), "\n"))
    removed = F.exists(orig_lines, lambda o: ~F.array_contains(fix_lines, o))
    impact_ok = removed & safe_ok
    blacklist_ok = ~_any(cwe, BLACKLIST, lambda s: fix.contains(s))
    whitelist_ok = _any(cwe, WHITELIST, lambda s: fix.contains(s))
    tests_ok = F.lit(False)
    for m in TEST_MARKERS:
        tests_ok = tests_ok | fix.contains(m)
    n_base = keywords_ok.cast("int") + impact_ok.cast("int") + safe_ok.cast("int")
    n_ctx = blacklist_ok.cast("int") + whitelist_ok.cast("int") + tests_ok.cast("int")
    conf = F.least(F.lit(1.0), n_base / 3.0 + n_ctx * 0.2)
    confidence = F.when(critical, F.round(conf, 6)).otherwise(F.lit(0.0))
    valid = F.when(critical, conf >= 0.8).otherwise(F.lit(True))
    return F.struct(
        critical.alias("is_critical"),
        F.when(critical, keywords_ok).alias("keywords_ok"), F.when(critical, impact_ok).alias("impact_ok"),
        F.when(critical, safe_ok).alias("safe_ok"), F.when(critical, blacklist_ok).alias("blacklist_ok"),
        F.when(critical, whitelist_ok).alias("whitelist_ok"), F.when(critical, tests_ok).alias("tests_ok"),
        confidence.alias("confidence"), valid.alias("valid"),
        F.when(critical, conf >= 0.8).otherwise(F.lit(False)).alias("verified"))
