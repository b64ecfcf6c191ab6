"""Queries: verdict parsing/validation (V1-V7), the verdict slot (U1) and
model-style verdicts for code_corpus (inputs of V2-V4 and G1-G8).

Raw model answers are built from ``events`` with the same string
concatenation on both sides (Spark / DuckDB), so each side parses its own
text: some answers miss a field, some carry two objects or lose the closing
brace, risk levels come as labels, digit strings or JSON numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dims import RISK_LABELS, sql_literal
from ..functions.lines import explode_rows, lines_l2, py_strip
from ..operators import rules as R
from ..operators import verdicts as V
from ..sources.tables import code_corpus, table
from .catalog import query
from .q_rules import TEXTS_SQL, _texts
from .sqlparts import CC, pystrip, values

LABELS_SQL = values(sorted(RISK_LABELS.items()), ["lbl", "lscore"])


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def raw_answers(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        "event_id", "event_type", "value", "props",
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    k, eid, et = F.col("k"), F.col("event_id"), F.col("event_type")
    om = F.when(eid % 5 == 0, eid % 12).otherwise(F.lit(-1))
    tenths = F.floor(F.col("value") / 5).cast("bigint")
    label = (F.when(et == "error", "High").when(et == "click", "low").when(et == "view", "N/A")
             .when(et == "signup", "7.5").otherwise("Severe"))
    risk_tok = (F.when(eid % 4 == 0, F.concat(F.lit('"'), label, F.lit('"')))
                .when(eid % 4 == 1, F.concat(_s(F.floor(tenths / 10).cast("bigint")), F.lit("."), _s(tenths % 10)))
                .when(eid % 4 == 2, _s(F.floor(F.col("value") / 4).cast("bigint")))
                .otherwise(F.concat(F.lit('"'), _s(k % 12), F.lit('"'))))
    fields = [
        F.concat(F.lit('"language": "'), et, F.lit('"')),
        F.concat(F.lit('"is_vulnerability": '), F.when(F.col("value") >= 25, "true").otherwise("false")),
        F.concat(F.lit('"vulnerabilityType": "type-'), _s(k % 7), F.lit('"')),
        F.concat(F.lit('"cwe": "CWE-'), _s(k % 40 + 10), F.lit('"')),
        F.concat(F.lit('"vulnerabilityLines": [{"lineNum": '), _s(k % 6), F.lit(', "lineCode": "line '), _s(k), F.lit('"}]')),
        F.concat(F.lit('"riskLevel": '), risk_tok),
        F.concat(F.lit('"explanation": "event '), _s(eid), F.lit('"')),
        F.concat(F.lit('"fixCode": "x = '), _s(k), F.lit('"')),
    ]
    body = F.concat_ws(", ", *[F.when(om != i, f) for i, f in enumerate(fields)],
                       F.concat(F.lit('"detail": '), F.col("props")))
    raw = (F.when(eid % 17 == 0, F.concat(F.lit("A: "), F.col("props"), F.lit(" B: "), F.col("props")))
           .otherwise(F.concat(F.lit("Model says: {"), body,
                               F.when(eid % 13 == 0, F.lit("")).otherwise(F.lit("}")), F.lit(" -- end"))))
    return ev.select("event_id", "event_type", "props", raw.alias("raw"))


RAW_SQL = """ev AS (SELECT event_id, event_type, value, props, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                  CASE WHEN event_id % 5 = 0 THEN event_id % 12 ELSE -1 END AS om FROM events),
rt AS (SELECT *, CASE event_id % 4
          WHEN 0 THEN '"' || CASE event_type WHEN 'error' THEN 'High' WHEN 'click' THEN 'low' WHEN 'view' THEN 'N/A'
                                   WHEN 'signup' THEN '7.5' ELSE 'Severe' END || '"'
          WHEN 1 THEN CAST(CAST(floor(value / 5) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST(floor(value / 5) AS BIGINT) % 10 AS VARCHAR)
          WHEN 2 THEN CAST(CAST(floor(value / 4) AS BIGINT) AS VARCHAR)
          ELSE '"' || CAST(k % 12 AS VARCHAR) || '"' END AS risk_tok FROM ev),
raw AS (SELECT event_id, event_type, props, CASE WHEN event_id % 17 = 0 THEN 'A: ' || props || ' B: ' || props ELSE
  'Model says: {' || concat_ws(', ',
    CASE WHEN om <> 0 THEN '"language": "' || event_type || '"' END,
    CASE WHEN om <> 1 THEN '"is_vulnerability": ' || CASE WHEN value >= 25 THEN 'true' ELSE 'false' END END,
    CASE WHEN om <> 2 THEN '"vulnerabilityType": "type-' || CAST(k % 7 AS VARCHAR) || '"' END,
    CASE WHEN om <> 3 THEN '"cwe": "CWE-' || CAST(k % 40 + 10 AS VARCHAR) || '"' END,
    CASE WHEN om <> 4 THEN '"vulnerabilityLines": [{"lineNum": ' || CAST(k % 6 AS VARCHAR) || ', "lineCode": "line ' || CAST(k AS VARCHAR) || '"}]' END,
    CASE WHEN om <> 5 THEN '"riskLevel": ' || risk_tok END,
    CASE WHEN om <> 6 THEN '"explanation": "event ' || CAST(event_id AS VARCHAR) || '"' END,
    CASE WHEN om <> 7 THEN '"fixCode": "x = ' || CAST(k AS VARCHAR) || '"' END,
    '"detail": ' || props)
  || CASE WHEN event_id % 13 = 0 THEN '' ELSE '}' END || ' -- end' END AS raw FROM rt),
pj AS (SELECT *, regexp_extract(raw, '(?s)\\{.*\\}', 0) AS j FROM raw),
pq AS (SELECT event_id, event_type, props, CASE WHEN json_valid(j) THEN j END AS j FROM pj),
pv AS (SELECT event_id, event_type, props, coalesce(json_type(j) = 'OBJECT', false) AS ok, j FROM pq),
pf AS (SELECT event_id, event_type, props, ok,
          CASE WHEN ok THEN json_extract_string(j, '$.language') END AS language,
          CASE WHEN ok THEN CAST(json_extract(j, '$.is_vulnerability') AS BOOLEAN) END AS is_vulnerability,
          CASE WHEN ok THEN json_extract_string(j, '$.vulnerabilityType') END AS vulnerability_type,
          CASE WHEN ok THEN json_extract_string(j, '$.cwe') END AS cwe,
          CASE WHEN ok THEN json_extract(j, '$.vulnerabilityLines') END AS vlines,
          CASE WHEN ok THEN json_extract_string(j, '$.riskLevel') END AS risk_raw,
          CASE WHEN ok AND json_extract_string(j, '$.riskLevel') IS NOT NULL THEN json_type(j, '$.riskLevel') <> 'VARCHAR' END AS risk_numeric,
          CASE WHEN ok THEN json_extract_string(j, '$.explanation') END AS explanation,
          CASE WHEN ok THEN json_extract_string(j, '$.fixCode') END AS fix_code
       FROM pv)"""


@query("parse_verdict", f"""WITH {RAW_SQL}
SELECT event_id, ok AS parsed_ok, language, is_vulnerability, cwe,
       CAST(json_array_length(vlines) AS INTEGER) AS n_lines, risk_raw, risk_numeric FROM pf""")
def q_parse_verdict(spark, sf_dir):
    p = V.with_parsed(raw_answers(spark, sf_dir), "raw")
    v = F.col("verdict")
    vl = v["vulnerabilityLines"]
    return p.select("event_id", v.isNotNull().alias("parsed_ok"), v["language"].alias("language"),
                    v["is_vulnerability"].alias("is_vulnerability"), v["cwe"].alias("cwe"),
                    F.when(vl.isNotNull(), F.size(vl)).alias("n_lines"), v["riskLevel"].alias("risk_raw"),
                    "risk_numeric")


def _risk_sql(raw: str, is_num: str) -> tuple[str, str]:
    """(score, reason) SQL expressions of V5."""
    digits = f"regexp_matches({raw}, '^[0-9]+$')"
    numish = f"(coalesce({is_num}, false) OR {digits})"
    num = f"TRY_CAST({raw} AS DOUBLE)"
    label = f"(SELECT lscore FROM {LABELS_SQL} WHERE lbl = lower({raw}))"
    score = (f"CASE WHEN {raw} IS NULL THEN NULL WHEN {numish} THEN CASE WHEN {num} BETWEEN 0 AND 10 THEN {num} END "
             f"ELSE {label} END")
    reason = (f"CASE WHEN {raw} IS NULL THEN 'missing' WHEN {numish} THEN CASE WHEN {num} IS NULL OR NOT ({num} BETWEEN 0 AND 10) "
              f"THEN 'out_of_range' END WHEN {label} IS NULL THEN 'bad_label' END")
    return score, reason


_SC, _RE = _risk_sql("risk_raw", "risk_numeric")


@query("validate_verdicts", f"""WITH {RAW_SQL},
rr AS (SELECT *, {_SC} AS score, {_RE} AS rreason FROM pf),
rs AS (SELECT event_id, CASE WHEN NOT ok THEN 'bad_json'
    WHEN language IS NULL THEN 'missing:language' WHEN is_vulnerability IS NULL THEN 'missing:is_vulnerability'
    WHEN vulnerability_type IS NULL THEN 'missing:vulnerabilityType' WHEN cwe IS NULL THEN 'missing:cwe'
    WHEN vlines IS NULL THEN 'missing:vulnerabilityLines' WHEN risk_raw IS NULL THEN 'missing:riskLevel'
    WHEN explanation IS NULL THEN 'missing:explanation' WHEN fix_code IS NULL THEN 'missing:fixCode'
    WHEN rreason IS NOT NULL THEN 'risk:' || rreason END AS reason, score FROM rr)
SELECT event_id, reason IS NULL AS accepted, reason, CASE WHEN reason IS NULL THEN CAST(score AS DOUBLE) END AS risk_score FROM rs""")
def q_validate_verdicts(spark, sf_dir):
    p = V.with_parsed(raw_answers(spark, sf_dir), "raw")
    return p.select("event_id", V.validate().alias("v")).select("event_id", "v.accepted", "v.reason", "v.risk_score")


#: Replacements that give some answers a field of a wrong type: (every nth event, text, its replacement).
RETYPED = [(19, '"is_vulnerability": true', '"is_vulnerability": "yes"'), (23, '"lineNum": ', '"lineNum": 0.5, "at": '),
           (29, '"cwe": "CWE-', '"cwe": 1, "old_cwe": "CWE-'), (31, '"riskLevel": ', '"riskLevel": [1], "old_risk": '),
           (37, '"vulnerabilityLines": [', '"vulnerabilityLines": [null, '), (41, '"fixCode": "', '"fixCode": null, "old_fix": "')]


def _retyped_sql() -> str:
    raw = "raw"
    for n, a, b in RETYPED:
        raw = f"CASE WHEN event_id % {n} = 0 THEN replace({raw}, {sql_literal(a)}, {sql_literal(b)}) ELSE {raw} END"
    kind = lambda f: f"json_type(j, '$.{f}')"
    wrong = {f: f"{kind(f)} <> 'VARCHAR'" for f in ("language", "vulnerabilityType", "cwe", "explanation", "fixCode")}
    wrong["is_vulnerability"] = f"{kind('is_vulnerability')} <> 'BOOLEAN'"
    wrong["riskLevel"] = f"{kind('riskLevel')} NOT IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE')"
    wrong["vulnerabilityLines"] = (f"({kind('vulnerabilityLines')} <> 'ARRAY' OR len(list_filter(CAST(json_extract(j, '$.vulnerabilityLines') AS JSON[]), lambda e: "
                                   "coalesce(json_type(e, '$.lineNum'), '') NOT IN ('BIGINT', 'UBIGINT') OR coalesce(json_type(e, '$.lineCode'), '') <> 'VARCHAR')) > 0)")
    checks = " ".join(f"WHEN coalesce({kind(f)}, 'NULL') = 'NULL' THEN 'missing:{f}' WHEN {wrong[f]} THEN 'bad_type:{f}'" for f in V.REQUIRED)
    return f"""WITH {RAW_SQL.split("pj AS (")[0]}
t AS (SELECT event_id, regexp_extract({raw}, '(?s)\\{{.*\\}}', 0) AS j FROM raw),
q AS (SELECT event_id, CASE WHEN json_valid(j) AND json_type(j) = 'OBJECT' THEN j END AS j FROM t),
r AS (SELECT event_id, j, json_extract_string(j, '$.riskLevel') AS risk_raw, json_type(j, '$.riskLevel') <> 'VARCHAR' AS risk_numeric FROM q),
s AS (SELECT event_id, CASE WHEN j IS NULL THEN 'bad_json' {checks} WHEN {_RE} IS NOT NULL THEN 'risk:' || {_RE} END AS reason FROM r)
SELECT event_id, reason IS NULL AS accepted, reason FROM s"""


@query("validate_types", _retyped_sql())
def q_validate_types(spark, sf_dir):
    rows = raw_answers(spark, sf_dir)
    for n, a, b in RETYPED:
        rows = rows.withColumn("raw", F.when(F.col("event_id") % n == 0, F.replace("raw", F.lit(a), F.lit(b))).otherwise(F.col("raw")))
    return V.with_parsed(rows, "raw").select("event_id", V.validate().alias("v")).select("event_id", "v.accepted", "v.reason")


_SC2, _RE2 = _risk_sql("raw", "is_num")


@query("normalize_risk", f"""WITH x AS (
  SELECT 'order' AS src, o_orderkey AS id, regexp_replace(o_orderpriority, '^[0-9]+-', '') AS raw, false AS is_num FROM orders
  UNION ALL SELECT 'part', p_partkey, CAST(p_size AS VARCHAR), true FROM part)
SELECT src, id, raw, CAST({_SC2} AS DOUBLE) AS risk_score, {_RE2} AS reason FROM x""")
def q_normalize_risk(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.lit("order").alias("src"), F.col("o_orderkey").alias("id"),
                                              F.regexp_replace("o_orderpriority", "^[0-9]+-", "").alias("raw"),
                                              F.lit(False).alias("is_num"))
    p = table(spark, sf_dir, "part").select(F.lit("part").alias("src"), F.col("p_partkey").alias("id"),
                                            F.col("p_size").cast("string").alias("raw"), F.lit(True).alias("is_num"))
    u = o.unionByName(p)
    r = V.normalize_risk(F.col("raw"), F.col("is_num"))
    return u.select("src", "id", "raw", r["risk_score"].alias("risk_score"), r["reason"].alias("reason"))


@query("verdict_defaults", f"""WITH {RAW_SQL},
vl AS (SELECT pf.event_id, count(*) AS n FROM pf, unnest(CAST(pf.vlines AS STRUCT(lineNum INTEGER, lineCode VARCHAR)[])) AS u(l)
       WHERE l.lineNum BETWEEN 1 AND len(string_split(props, chr(10))) GROUP BY pf.event_id)
SELECT pf.event_id, NOT ok AS failed, event_type AS language,
       CASE WHEN ok THEN coalesce(is_vulnerability, false) ELSE false END AS is_vulnerability,
       CASE WHEN ok THEN coalesce(vulnerability_type, '') ELSE '' END AS vulnerability_type,
       CAST(coalesce(vl.n, 0) AS INTEGER) AS n_lines,
       CASE WHEN ok THEN coalesce(risk_raw, 'Medium') ELSE 'None' END AS risk_raw,
       CASE WHEN ok THEN coalesce(explanation, '') ELSE 'Analysis failed' END AS explanation,
       CASE WHEN NOT ok THEN props
            WHEN len(string_split(coalesce(fix_code, props), chr(10))) <> len(string_split(props, chr(10))) THEN props
            ELSE coalesce(fix_code, props) END AS fix_code
FROM pf LEFT JOIN vl ON vl.event_id = pf.event_id""")
def q_verdict_defaults(spark, sf_dir):
    p = V.with_parsed(raw_answers(spark, sf_dir), "raw")
    d = p.select("event_id", V.with_defaults("verdict", F.col("event_type"), F.col("props")).alias("d"))
    return d.select("event_id", F.col("d.failed").alias("failed"), F.col("d.language").alias("language"),
                    F.col("d.is_vulnerability").alias("is_vulnerability"),
                    F.col("d.vulnerabilityType").alias("vulnerability_type"),
                    F.size("d.vulnerabilityLines").alias("n_lines"), F.col("d.riskLevel").alias("risk_raw"),
                    F.col("d.explanation").alias("explanation"), F.col("d.fixCode").alias("fix_code"))


# ------------------------------------------------------------------ model-style verdicts on code_corpus

FIX_MARKERS = {"python": "# Test case for vulnerability fix", "c": "// Vulnerability test",
               "javascript": "describe('Security fix verification'"}
HIT_MARKERS = {"python": "eval(", "c": "strcpy(", "javascript": "innerHTML"}


def model_verdicts(spark, sf_dir):
    """One verdict per code_corpus file, shaped like a model answer
    (some fields missing, out-of-range line numbers, fixes of another length)."""
    cc = code_corpus(spark, sf_dir)
    lang, ps = F.col("lang"), F.col("p_size")
    marker = F.when(lang == "python", HIT_MARKERS["python"]).when(lang == "c", HIT_MARKERS["c"]).otherwise(HIT_MARKERS["javascript"])
    cc = cc.withColumn("_ls", lines_l2("code"))
    hit = F.array_position(F.transform("_ls", lambda l: l.contains(marker)), True).cast("int")
    cc = cc.withColumn("_hit", hit)
    hit_code = py_strip(F.element_at("_ls", F.greatest(F.col("_hit"), F.lit(1))))
    fixed = F.replace(F.replace(F.replace(F.col("code"), F.lit("eval(y)"), F.lit("int(y)")),
                                F.lit("strcpy(b, s)"), F.lit("strncpy(b, s, 1)")),
                      F.lit("innerHTML = u"), F.lit("append(DOMPurify.sanitize(u))"))
    tmark = F.when(lang == "python", FIX_MARKERS["python"]).when(lang == "c", FIX_MARKERS["c"]).otherwise(FIX_MARKERS["javascript"])
    cwe = F.when(lang == "python", F.when(ps % 2 == 0, "CWE-78").otherwise("CWE-20")).when(lang == "c", "CWE-787").otherwise("CWE-79")
    vtype = (F.when(ps % 9 == 0, F.lit(None).cast("string"))
             .when(lang == "python", F.when(ps % 2 == 0, "OS Command Injection").otherwise("Improper Input Validation"))
             .when(lang == "c", "Buffer Overflow").otherwise("Cross-site Scripting (XSS)"))
    verdict = F.struct(
        lang.alias("language"),
        F.when(ps % 8 == 0, F.lit(None).cast("boolean")).otherwise((lang != "javascript") | (ps > 25)).alias("is_vulnerability"),
        vtype.alias("vulnerabilityType"), cwe.alias("cwe"),
        F.array(F.struct(F.col("_hit").alias("lineNum"), hit_code.alias("lineCode")),
                F.struct((ps % 12).cast("int").alias("lineNum"), F.lit("guess").alias("lineCode")),
                F.struct(F.lit(0).alias("lineNum"), F.lit("").alias("lineCode"))).alias("vulnerabilityLines"),
        F.when(ps % 6 == 0, F.lit(None).cast("string")).otherwise((ps % 11).cast("string")).alias("riskLevel"),
        F.when(ps % 4 == 0, F.lit(None).cast("string")).otherwise(F.lit("flagged by rule")).alias("explanation"),
        F.when(ps % 10 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(fixed, F.when(ps % 5 == 0, F.concat(tmark, F.lit("\n"))).otherwise(F.lit(""))))
         .alias("fixCode"))
    return cc.select("file_id", "lang", "code", "p_size", verdict.alias("verdict"))


MV_SQL = f"""{CC},
m0 AS (SELECT *, string_split(code, chr(10)) AS ls,
         CASE lang WHEN 'python' THEN 'eval(' WHEN 'c' THEN 'strcpy(' ELSE 'innerHTML' END AS marker,
         CASE lang WHEN 'python' THEN '# Test case for vulnerability fix' WHEN 'c' THEN '// Vulnerability test'
                   ELSE 'describe(''Security fix verification''' END AS tmark FROM cc),
m1 AS (SELECT *, CAST(coalesce(list_position(list_transform(ls, lambda l: contains(l, marker)), true), 0) AS INTEGER) AS hit FROM m0),
mv AS (SELECT file_id, lang, code, p_size,
    CASE WHEN p_size % 8 = 0 THEN NULL ELSE lang <> 'javascript' OR p_size > 25 END AS is_vulnerability,
    CASE WHEN p_size % 9 = 0 THEN NULL WHEN lang = 'python' THEN CASE WHEN p_size % 2 = 0 THEN 'OS Command Injection' ELSE 'Improper Input Validation' END
         WHEN lang = 'c' THEN 'Buffer Overflow' ELSE 'Cross-site Scripting (XSS)' END AS vtype,
    CASE WHEN lang = 'python' THEN CASE WHEN p_size % 2 = 0 THEN 'CWE-78' ELSE 'CWE-20' END WHEN lang = 'c' THEN 'CWE-787' ELSE 'CWE-79' END AS cwe,
    hit, {pystrip('ls[greatest(hit, 1)]')} AS hit_code,
    CASE WHEN p_size % 6 = 0 THEN NULL ELSE CAST(p_size % 11 AS VARCHAR) END AS risk_raw,
    CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'flagged by rule' END AS explanation,
    CASE WHEN p_size % 10 = 0 THEN NULL ELSE
      replace(replace(replace(code, 'eval(y)', 'int(y)'), 'strcpy(b, s)', 'strncpy(b, s, 1)'), 'innerHTML = u', 'append(DOMPurify.sanitize(u))')
      || CASE WHEN p_size % 5 = 0 THEN tmark || chr(10) ELSE '' END END AS fix_code
  FROM m1),
mvl AS (SELECT file_id, hit AS line_num, hit_code AS line_code FROM mv
        UNION ALL SELECT file_id, CAST(p_size % 12 AS INTEGER), 'guess' FROM mv
        UNION ALL SELECT file_id, 0, '' FROM mv)"""


@query("clip_lines", f"""WITH {MV_SQL}
SELECT l.file_id, l.line_num, l.line_code,
       {pystrip('l.line_code')} = {pystrip('string_split(mv.code, chr(10))[l.line_num]')} AS line_matches
FROM mvl l JOIN mv ON mv.file_id = l.file_id
WHERE l.line_num BETWEEN 1 AND len(string_split(mv.code, chr(10)))""")
def q_clip_lines(spark, sf_dir):
    mv = model_verdicts(spark, sf_dir)
    mv = mv.withColumn("kept", V.clip_lines(F.col("verdict.vulnerabilityLines"), F.col("code")))
    return (explode_rows(mv, ["file_id"], "kept", "l")
            .select("file_id", F.col("l.lineNum").alias("line_num"), F.col("l.lineCode").alias("line_code"),
                    F.col("l.line_matches").alias("line_matches")))


@query("guard_fix", f"""WITH {MV_SQL}
SELECT file_id, len(string_split(coalesce(fix_code, code), chr(10))) <> len(string_split(code, chr(10))) AS fix_replaced,
       sha256(CASE WHEN len(string_split(coalesce(fix_code, code), chr(10))) <> len(string_split(code, chr(10))) THEN code
                   ELSE coalesce(fix_code, code) END) AS fix_hash
FROM mv""")
def q_guard_fix(spark, sf_dir):
    mv = model_verdicts(spark, sf_dir)
    guarded = V.guard_fix(F.col("verdict.fixCode"), F.col("code"))
    fix0 = F.coalesce(F.col("verdict.fixCode"), F.col("code"))
    return mv.select("file_id", (F.size(lines_l2(fix0)) != F.size(lines_l2("code"))).alias("fix_replaced"),
                     F.sha2(guarded, 256).alias("fix_hash"))


# ------------------------------------------------------------------ U1

SEV_RANK_SQL = values([("info", 0), ("low", 1), ("medium", 2), ("high", 3), ("critical", 4)], ["sv", "rk"])


@query("scan_verdicts", f"""WITH {TEXTS_SQL},
fl AS (SELECT h.*, r.rk FROM hits h JOIN {SEV_RANK_SQL} r ON r.sv = h.severity WHERE h.cwe IS NOT NULL),
top AS (SELECT src, id, cwe, severity FROM (SELECT *, row_number() OVER (PARTITION BY src, id ORDER BY rk DESC, line_no, check_id) AS rn FROM fl) WHERE rn = 1),
agg AS (SELECT src, id, count(*) AS n, string_agg(message, '; ' ORDER BY line_no, check_id) AS expl FROM fl GROUP BY src, id)
SELECT t.src, t.id, agg.n IS NOT NULL AS is_vulnerability, coalesce(top.cwe, '') AS cwe,
       CAST(coalesce(agg.n, 0) AS INTEGER) AS n_lines, coalesce(top.severity, 'info') AS severity,
       coalesce(agg.expl, 'no rule finding') AS explanation
FROM texts t LEFT JOIN top ON top.src = t.src AND top.id = t.id LEFT JOIN agg ON agg.src = t.src AND agg.id = t.id""")
def q_scan_verdicts(spark, sf_dir):
    f = R.with_findings(_texts(spark, sf_dir), "text", "lang")
    req = f.select("src", "id", "lang", R.work_key("text", "findings").alias("work_key"),
                   V.findings_for_fn("findings").alias("findings_json"))
    return (V.scan_verdicts(req, ["src", "id"])
            .select("src", "id", "is_vulnerability", "cwe", "n_lines", "severity", "explanation"))


# ------------------------------------------------------------------ E1 end to end

def _scan_source_sql() -> str:
    from .q_chunks import blocks_sql, fallback_sql
    from .q_rules import RULES_SQL
    return f"""WITH RECURSIVE {blocks_sql(CC + ", files AS (SELECT file_id, lang, code FROM cc)")},
{fallback_sql("srcs AS (SELECT 'code' AS src, file_id AS id, lang, code AS text FROM files WHERE file_id NOT IN (SELECT file_id FROM blk))")},
ch AS (SELECT file_id, chunk_no, start_line, end_line, text FROM blk
       UNION ALL SELECT id, chunk_no, start_line, end_line, text FROM fb),
cl AS (SELECT ch.file_id, ch.chunk_no, cc.lang, unnest(string_split(ch.text, chr(10))) AS line,
              generate_subscripts(string_split(ch.text, chr(10)), 1) AS line_no
       FROM ch JOIN cc ON cc.file_id = ch.file_id),
hh AS (SELECT cl.file_id, cl.chunk_no, cl.line_no, cl.line, r.rule_id AS check_id, r.cwe, r.severity, r.message, s.rk
       FROM cl JOIN {RULES_SQL} r ON (r.rlang = '*' OR r.rlang = cl.lang) AND regexp_matches(cl.line, r.regex)
       JOIN {SEV_RANK_SQL} s ON s.sv = r.severity WHERE r.cwe IS NOT NULL),
said AS (SELECT file_id, chunk_no, string_agg(message, '; ' ORDER BY line_no, check_id) AS expl FROM hh GROUP BY file_id, chunk_no),
vl AS (SELECT d.file_id, d.chunk_no, string_agg(CAST(ch.start_line + d.line_no - 1 AS VARCHAR) || ': ' || {pystrip('d.line')}, chr(10) ORDER BY d.line_no) AS vlines
       FROM (SELECT DISTINCT file_id, chunk_no, line_no, line FROM hh) d
       JOIN ch ON ch.file_id = d.file_id AND ch.chunk_no = d.chunk_no GROUP BY d.file_id, d.chunk_no),
top AS (SELECT file_id, chunk_no, cwe, severity, n FROM (
          SELECT *, row_number() OVER (PARTITION BY file_id, chunk_no ORDER BY rk DESC, line_no, check_id) AS rn,
                 count(*) OVER (PARTITION BY file_id, chunk_no) AS n FROM hh) WHERE rn = 1)
SELECT ch.file_id, ch.chunk_no, ch.start_line, ch.end_line, sha256(ch.text) AS chunk_hash,
       top.n IS NOT NULL AS is_vulnerability, coalesce(top.cwe, '') AS cwe, coalesce(top.severity, 'info') AS severity,
       CAST(coalesce(top.n, 0) AS INTEGER) AS n_flagged, coalesce(vl.vlines, '') AS vulnerable_lines,
       coalesce(said.expl, 'no rule finding') AS explanation, sha256(ch.text) AS fix_hash, CAST(NULL AS VARCHAR) AS error
FROM ch LEFT JOIN top ON top.file_id = ch.file_id AND top.chunk_no = ch.chunk_no
LEFT JOIN said ON said.file_id = ch.file_id AND said.chunk_no = ch.chunk_no
LEFT JOIN vl ON vl.file_id = ch.file_id AND vl.chunk_no = ch.chunk_no"""


@query("scan_source", _scan_source_sql(), kind="R")
def q_scan_source(spark, sf_dir):
    from .pipeline import scan_source
    rows = scan_source(code_corpus(spark, sf_dir))
    said = F.transform("vulnerable_lines", lambda x: F.concat(x["line"].cast("string"), F.lit(": "), x["code"]))
    return rows.select("file_id", "chunk_no", "start_line", "end_line", "chunk_hash", "is_vulnerability", "cwe", "severity", "n_flagged",
                       F.array_join(said, "\n").alias("vulnerable_lines"), "explanation", F.sha2("fix_code", 256).alias("fix_hash"), "error")
