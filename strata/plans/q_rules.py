"""Queries: rule scan, digests, findings JSON, work keys, requests (R1-R5, K2, H2, P7, A7 slice)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dims import RULES, SEVERITY_BUCKETS, SEVERITY_SCORE
from ..functions.lines import explode_rows
from ..operators import patterns as U
from ..operators import rules as R
from ..operators.consensus import severity_bucket
from ..sources.tables import code_corpus, table
from .catalog import query
from .sqlparts import CC, pystrip, values

RULES_SQL = values(RULES, ["rule_id", "rlang", "regex", "message", "cwe", "severity"])
PATTERNS_SQL = values([(lang, p) for lang, ps in sorted(R.patterns_by_lang().items()) for p in ps],
                      ["language", "pattern"])
SCORE_SQL = values(sorted(SEVERITY_SCORE.items()), ["sev", "score"])
BUCKETS_SQL = values(SEVERITY_BUCKETS, ["bucket", "lo", "hi"])

TEXTS_SQL = f"""{CC},
texts AS (SELECT 'doc' AS src, doc_id AS id, lang, text FROM documents
          UNION ALL SELECT 'code', file_id, lang, code FROM cc),
tl AS (SELECT src, id, lang, unnest(string_split(text, chr(10))) AS line,
              CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no FROM texts),
hits AS (SELECT tl.src, tl.id, tl.line_no, r.rule_id AS check_id, r.message, r.cwe, r.severity
         FROM tl JOIN {RULES_SQL} r ON (r.rlang = '*' OR r.rlang = tl.lang) AND regexp_matches(tl.line, r.regex))"""


def _texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"),
                                                 "lang", "text")
    c = code_corpus(spark, sf_dir).select(F.lit("code").alias("src"), F.col("file_id").alias("id"),
                                          "lang", F.col("code").alias("text"))
    return d.unionByName(c)


@query("rule_findings", f"WITH {TEXTS_SQL} SELECT * FROM hits")
def q_rule_findings(spark, sf_dir):
    return R.explode_findings(R.with_findings(_texts(spark, sf_dir), "text", "lang"), ["src", "id"])


@query("findings_digest", f"""WITH {TEXTS_SQL}
SELECT src, id, CAST(count(*) AS BIGINT) AS n_findings,
  string_agg('- Rule: ' || check_id || chr(10) || '  - Issue: ' || coalesce(message, 'No description') || chr(10)
             || '  - Line: ' || coalesce(CAST(line_no AS VARCHAR), 'Unknown') || chr(10), '' ORDER BY line_no, check_id) AS digest
FROM hits GROUP BY src, id""")
def q_findings_digest(spark, sf_dir):
    f = R.with_findings(_texts(spark, sf_dir), "text", "lang").filter(F.size("findings") > 0)
    return f.select("src", "id", F.size("findings").cast("bigint").alias("n_findings"),
                    R.findings_digest("findings").alias("digest"))


@query("scan_with_findings", f"""WITH {TEXTS_SQL},
dg AS (SELECT src, id, count(*) AS n,
  string_agg('- Rule: ' || check_id || chr(10) || '  - Issue: ' || coalesce(message, 'No description') || chr(10)
             || '  - Line: ' || coalesce(CAST(line_no AS VARCHAR), 'Unknown') || chr(10), '' ORDER BY line_no, check_id) AS d
  FROM hits WHERE src = 'code' GROUP BY src, id)
SELECT cc.file_id, cc.lang, CAST(coalesce(dg.n, 0) AS BIGINT) AS n_findings, dg.n IS NOT NULL AS has_findings,
       coalesce(chr(10) || chr(10) || '### Rule findings:' || chr(10) || dg.d, '') AS digest
FROM cc LEFT JOIN dg ON dg.id = cc.file_id""")
def q_scan_with_findings(spark, sf_dir):
    return R.scan_with_findings(code_corpus(spark, sf_dir), "code", "lang", ["file_id"])


JSON_SQL = f"""{TEXTS_SQL},
js AS (SELECT id, '[' || string_agg('{{"check_id":"' || check_id || '","start":{{"line":' || line_no || '}},"extra":{{'
        || CASE WHEN message IS NULL THEN '' ELSE '"message":"' || message || '"' END || '}}}}', ',' ORDER BY line_no, check_id) || ']' AS j
       FROM hits WHERE src = 'code' GROUP BY id)"""


@query("results_to_json", f"""WITH {JSON_SQL}
SELECT cc.file_id, coalesce(js.j, '[]') AS findings_json FROM cc LEFT JOIN js ON js.id = cc.file_id""")
def q_results_to_json(spark, sf_dir):
    f = R.with_findings(code_corpus(spark, sf_dir), "code", "lang")
    return f.select("file_id", R.findings_json("findings").alias("findings_json"))


@query("work_key", f"""WITH {JSON_SQL}
SELECT cc.file_id, sha256(cc.code || coalesce(js.j, '[]')) AS work_key FROM cc LEFT JOIN js ON js.id = cc.file_id""")
def q_work_key(spark, sf_dir):
    f = R.with_findings(code_corpus(spark, sf_dir), "code", "lang")
    return f.select("file_id", R.work_key("code", "findings").alias("work_key"))


@query("build_requests", f"""WITH {TEXTS_SQL},
dg AS (SELECT id, string_agg('- Rule: ' || check_id || chr(10) || '  - Issue: ' || coalesce(message, 'No description')
          || chr(10) || '  - Line: ' || CAST(line_no AS VARCHAR) || chr(10), '' ORDER BY line_no, check_id) AS d
       FROM hits WHERE src = 'code' GROUP BY id)
SELECT cc.file_id, 'Review the following ' || cc.lang || ' code for security weaknesses. '
  || 'Report the weakness type, CWE id, affected lines with numbers, a risk score 0-10, '
  || 'an explanation and the whole block with a fix, as one JSON object.'
  || chr(10) || chr(10) || '### Code:' || chr(10) || cc.code
  || coalesce(chr(10) || chr(10) || '### Rule findings:' || chr(10) || dg.d, '') AS request
FROM cc LEFT JOIN dg ON dg.id = cc.file_id""")
def q_build_requests(spark, sf_dir):
    s = R.scan_with_findings(code_corpus(spark, sf_dir), "code", "lang", ["file_id", "code"])
    return s.select("file_id", R.build_request("lang", "code", "digest").alias("request"))


@query("pattern_lines", f"""WITH {CC},
l AS (SELECT file_id, lang, unnest(string_split(code, chr(10))) AS line,
             CAST(generate_subscripts(string_split(code, chr(10)), 1) AS INTEGER) AS line_no FROM cc)
SELECT file_id, p.pattern, line_no, {pystrip('line')} AS line_code
FROM l JOIN {PATTERNS_SQL} p ON p.language = l.lang AND contains(l.line, p.pattern)""")
def q_pattern_lines(spark, sf_dir):
    cc = code_corpus(spark, sf_dir)
    cc = cc.withColumn("hits", R.pattern_hits("code", "lang"))
    return (explode_rows(cc, ["file_id"], "hits", "h")
            .select("file_id", "h.pattern", "h.line_no", "h.line_code"))


@query("user_patterns", f"""
WITH w AS (SELECT regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT array_to_string(ws[i:i + n - 1], ' ') AS pattern
      FROM (SELECT ws, unnest(range(1, len(ws) - n + 2)) AS i, n FROM w, (SELECT unnest([2, 3]) AS n) WHERE len(ws) >= n)),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no FROM documents)
SELECT doc_id, pattern, line_no, sha256({pystrip('line')}) AS line_hash FROM l JOIN p ON contains(line, pattern)""")
def q_user_patterns(spark, sf_dir):
    """A user's table of patterns (every two and three words of the benchmark passages) against every line of the documents."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    b = table(spark, sf_dir, "benchmark").select(words.alias("w"))

    def windows_of(n):
        return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " ")))
    windows = [windows_of(2), windows_of(3)]
    none = F.array().cast("array<string>")
    b = b.select(F.concat(*[F.coalesce(w, none) for w in windows]).alias("p"))
    found = U.matches(table(spark, sf_dir, "documents"), "doc_id", "text", explode_rows(b, [], "p", "pattern"))
    return found.select("doc_id", "pattern", "line_no", F.sha2("line_code", 256).alias("line_hash"))


@query("patterns_by_lang", f"""WITH {CC},
p AS (SELECT language, string_agg(DISTINCT pattern, ' | ' ORDER BY pattern) AS patterns FROM {PATTERNS_SQL} GROUP BY language)
SELECT p.language AS lang, p.patterns, CAST(count(*) AS BIGINT) AS n_files FROM cc JOIN p ON p.language = cc.lang
GROUP BY p.language, p.patterns""")
def q_patterns_by_lang(spark, sf_dir):
    pats = (R.kb_patterns(spark).groupBy("language")
            .agg(F.array_join(F.array_sort(F.collect_set("pattern")), " | ").alias("patterns")))
    files = code_corpus(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).cast("bigint").alias("n_files"))
    return files.join(F.broadcast(pats), files.lang == pats.language).select("lang", "patterns", "n_files")


@query("finding_histogram", f"""WITH {TEXTS_SQL},
sc AS (SELECT h.cwe, s.score FROM hits h JOIN {SCORE_SQL} s ON s.sev = h.severity WHERE h.src = 'doc')
SELECT sc.cwe, b.bucket AS severity_bucket, CAST(count(*) AS BIGINT) AS n_findings
FROM sc LEFT JOIN {BUCKETS_SQL} b ON sc.score BETWEEN b.lo AND b.hi GROUP BY sc.cwe, b.bucket""")
def q_finding_histogram(spark, sf_dir):
    """Minimum slice: documents -> lines -> rule findings -> risk score ->
    severity bucket -> count per (cwe, bucket)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    f = R.explode_findings(R.with_findings(docs, "text", "lang"), ["doc_id"])
    scored = f.withColumn("severity_bucket", severity_bucket(R.severity_score("severity")))
    return scored.groupBy("cwe", "severity_bucket").agg(F.count(F.lit(1)).cast("bigint").alias("n_findings"))
