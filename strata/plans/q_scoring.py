"""Queries: fix-quality scoring of verdicts (G1-G8) and the flagged-only tail (P5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dims import (BLACKLIST, CRITICAL_CWE, CWE_KEYWORDS, SAFE_PATTERNS, TEST_MARKERS, WHITELIST,
                              sql_literal)
from ..operators.scoring import score_fix
from .catalog import query
from .q_verdicts import MV_SQL, model_verdicts
from .sqlparts import l1


def _case_any(table: dict, test) -> str:
    parts = [f"WHEN cwe = '{k}' THEN (" + " OR ".join(test(x) for x in items) + ")" for k, items in table.items()]
    return "CASE " + " ".join(parts) + " ELSE false END"


def _kw_sql() -> str:
    parts = [f"WHEN cwe = '{k}' THEN (" + " AND ".join(f"contains(vt, {sql_literal(w)})" for w in ws) + ")"
             for k, ws in CWE_KEYWORDS.items()]
    return "CASE " + " ".join(parts) + " ELSE true END"


SCORE_SQL = f"""WITH {MV_SQL},
s0 AS (SELECT file_id, is_vulnerability, cwe, lower(coalesce(vtype, '')) AS vt, coalesce(fix_code, '') AS fix,
              {l1("hit_code || chr(10) || 'guess' || chr(10) || ''")} AS orig FROM mv),
s1 AS (SELECT *, cwe IN ({', '.join(sql_literal(c) for c in CRITICAL_CWE)}) AS crit,
              {_kw_sql()} AS kw,
              {_case_any(SAFE_PATTERNS, lambda p: f"regexp_matches(fix, {sql_literal(p)}, 'i')")} AS safe,
              NOT {_case_any(BLACKLIST, lambda x: f"contains(fix, {sql_literal(x)})")} AS black,
              {_case_any(WHITELIST, lambda x: f"contains(fix, {sql_literal(x)})")} AS white,
              ({' OR '.join(f"contains(fix, {sql_literal(m)})" for m in TEST_MARKERS)}) AS tests,
              len(list_filter(orig, lambda o: NOT list_contains({l1('fix')}, o))) > 0 AS removed FROM s0),
s2 AS (SELECT *, removed AND safe AS impact,
              least(CAST(1.0 AS DOUBLE), (CAST(kw AS INTEGER) + CAST(removed AND safe AS INTEGER) + CAST(safe AS INTEGER)) / CAST(3.0 AS DOUBLE)
                    + (CAST(black AS INTEGER) + CAST(white AS INTEGER) + CAST(tests AS INTEGER)) * CAST(0.2 AS DOUBLE)) AS conf FROM s1)"""


@query("score_fixes", f"""{SCORE_SQL}
SELECT file_id, cwe, crit AS is_critical,
  CASE WHEN crit THEN kw END AS keywords_ok, CASE WHEN crit THEN impact END AS impact_ok, CASE WHEN crit THEN safe END AS safe_ok,
  CASE WHEN crit THEN black END AS blacklist_ok, CASE WHEN crit THEN white END AS whitelist_ok, CASE WHEN crit THEN tests END AS tests_ok,
  CASE WHEN crit THEN round(conf, 6) ELSE CAST(0.0 AS DOUBLE) END AS confidence,
  CASE WHEN crit THEN conf >= 0.8 ELSE true END AS valid, CASE WHEN crit THEN conf >= 0.8 ELSE false END AS verified
FROM s2""")
def q_score_fixes(spark, sf_dir):
    mv = model_verdicts(spark, sf_dir)
    v = F.col("verdict")
    s = mv.select("file_id", v["cwe"].alias("cwe"),
                  score_fix(v["cwe"], v["vulnerabilityType"], v["vulnerabilityLines"], v["fixCode"]).alias("s"))
    return s.select("file_id", "cwe", "s.*")


@query("flagged_only", f"""{SCORE_SQL}
SELECT file_id, cwe, CASE WHEN crit THEN round(conf, 6) ELSE CAST(0.0 AS DOUBLE) END AS confidence,
  CASE WHEN crit THEN conf >= 0.8 ELSE true END AS valid FROM s2 WHERE coalesce(is_vulnerability, false)""")
def q_flagged_only(spark, sf_dir):
    mv = model_verdicts(spark, sf_dir)
    v = F.col("verdict")
    flagged = mv.filter(F.coalesce(v["is_vulnerability"], F.lit(False)))
    s = flagged.select("file_id", v["cwe"].alias("cwe"),
                       score_fix(v["cwe"], v["vulnerabilityType"], v["vulnerabilityLines"], v["fixCode"]).alias("s"))
    return s.select("file_id", "cwe", "s.confidence", "s.valid")
