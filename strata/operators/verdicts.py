"""Verdict parsing and validation (V1-V7) and the verdict-function slot.

All parsing is JVM-side: ``regexp_extract`` for the greedy ``{...}`` span,
``from_json`` of ``[span]`` as an array (a second object or a truncated
object makes the array parse fail, which is the strict behaviour), and a
VARIANT view of the same text to tell a JSON number from a JSON string
for ``riskLevel``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dims import (DEFAULT_RISK, FAILED_EXPLANATION, FAILED_RISK, RISK_LABELS)
from ..functions.lines import lines_l2, py_strip

VULN_LINE = T.StructType([T.StructField("lineNum", T.IntegerType()), T.StructField("lineCode", T.StringType())])
VERDICT = T.StructType([
    T.StructField("language", T.StringType()),
    T.StructField("is_vulnerability", T.BooleanType()),
    T.StructField("vulnerabilityType", T.StringType()),
    T.StructField("cwe", T.StringType()),
    T.StructField("vulnerabilityLines", T.ArrayType(VULN_LINE)),
    T.StructField("riskLevel", T.StringType()),
    T.StructField("explanation", T.StringType()),
    T.StructField("fixCode", T.StringType()),
])
REQUIRED = [f.name for f in VERDICT.fields]
INTEGER_KINDS = ("BIGINT",)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def json_span(raw) -> Column:
    """V1: greedy first-'{' .. last-'}' span, dot matches newline ('' if none)."""
    return F.regexp_extract(_c(raw), r"(?s)\{.*\}", 0)


def with_parsed(df: DataFrame, raw: str, out: str = "verdict") -> DataFrame:
    """V1 + strict parse: adds ``out`` (struct VERDICT or null when the span
    is not exactly one JSON object), ``risk_numeric`` (riskLevel was a
    JSON number) and ``bad_types`` (fields whose JSON value has another type
    than VERDICT says; a wrong element makes its array wrong). An object that
    repeats a key is no VARIANT under Spark's defaults: its last value
    counts and no type is checked."""
    d = df.withColumn("_j", json_span(raw))
    arr = F.from_json(F.concat(F.lit("["), F.col("_j"), F.lit("]")), T.ArrayType(VERDICT))
    d = d.withColumn("_a", arr)
    ok = F.col("_a").isNotNull() & (F.size("_a") == 1)
    d = d.withColumn(out, F.when(ok, F.element_at("_a", 1)))
    d = d.withColumn("_v", F.when(ok, F.try_parse_json(F.col("_j"))))
    d = d.withColumn("risk_numeric", F.when(F.col(f"{out}.riskLevel").isNotNull(), ~_kind(F.col("_v"), "riskLevel").startswith("STRING")))
    return d.withColumn("bad_types", _wrong_types(F.col("_v"))).drop("_j", "_a", "_v")


def _kind(value: Column, field: str) -> Column:
    """JSON type of a field (VOID for a JSON null; null if there is none)."""
    return F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))


def _wrong_types(v: Column) -> Column:
    """Names of the fields of VERDICT whose value is there but of another type."""
    def wrong(value, field):
        kind, t = _kind(value, field), field_types[field]
        if isinstance(t, T.BooleanType):
            right = kind == "BOOLEAN"
        elif isinstance(t, T.IntegerType):
            right = kind.isin(*INTEGER_KINDS)
        elif field == "riskLevel":  # a label or a number
            right = (kind == "STRING") | kind.isin(*INTEGER_KINDS, "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        else:
            right = kind == "STRING"
        return kind.isNotNull() & (kind != "VOID") & ~right

    def wrong_line(e):
        # an element must be an object with both fields, rightly typed
        whole = F.schema_of_variant(e).startswith("OBJECT")
        fields = [_kind(e, f.name).isNotNull() & (_kind(e, f.name) != "VOID") & ~wrong(e, f.name) for f in VULN_LINE.fields]
        return ~(whole & fields[0] & fields[1])

    field_types = {f.name: f.dataType for s in (VERDICT, VULN_LINE) for f in s.fields}
    lines = F.try_variant_get(v, "$.vulnerabilityLines", "array<variant>")
    kind = _kind(v, "vulnerabilityLines")
    bad_lines = kind.isNotNull() & (kind != "VOID") & (lines.isNull() | F.exists(lines, wrong_line))
    checks = [F.when(bad_lines if name == "vulnerabilityLines" else wrong(v, name), F.lit(name)) for name in REQUIRED]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def normalize_risk(raw, is_numeric) -> Column:
    """V5: struct<risk_score double, reason string>.

    Numbers must lie in 0..10; a string of ASCII digits is read as an
    integer (then the same range); other strings are labels compared
    case-insensitively (none 0, low 1, medium 4, high 7, critical 9,
    n/a 0); everything else is rejected with a reason."""
    r = _c(raw)
    labels = F.create_map(*[F.lit(x) for kv in RISK_LABELS.items() for x in kv])
    as_num = r.try_cast("double")
    digits = r.rlike(r"^[0-9]+$")
    num = F.when(_c(is_numeric) | digits, as_num)
    in_range = (num >= 0.0) & (num <= 10.0)
    label = F.try_element_at(labels, F.lower(r))
    score = (F.when(r.isNull(), F.lit(None))
             .when(_c(is_numeric) | digits, F.when(in_range, num))
             .otherwise(label))
    reason = (F.when(r.isNull(), F.lit("missing"))
              .when(_c(is_numeric) | digits, F.when(~in_range | num.isNull(), F.lit("out_of_range")))
              .when(label.isNull(), F.lit("bad_label")))
    return F.struct(score.cast("double").alias("risk_score"), reason.alias("reason"))


def validate(verdict: str = "verdict", is_numeric: str = "risk_numeric", bad_types: str = "bad_types") -> Column:
    """V6/V7: struct<accepted boolean, reason string, risk_score double>.
    The reason names the first required field that is missing (or null) or of a
    wrong type, else a risk problem; an unparsed verdict is ``bad_json``."""
    v = F.col(verdict)
    risk = normalize_risk(v["riskLevel"], F.col(is_numeric))
    reason = F.when(v.isNull(), F.lit("bad_json"))
    for name in REQUIRED:
        reason = (reason.when(F.array_contains(F.col(bad_types), name), F.lit(f"bad_type:{name}"))
                  .when(v[name].isNull(), F.lit(f"missing:{name}")))
    reason = reason.when(risk["reason"].isNotNull(), F.concat(F.lit("risk:"), risk["reason"]))
    return F.struct(reason.isNull().alias("accepted"), reason.alias("reason"),
                    F.when(reason.isNull(), risk["risk_score"]).alias("risk_score"))


def clip_lines(lines, code) -> Column:
    """V2: keep vulnerabilityLines with 1 <= lineNum <= number of L2 lines of
    the code; each kept line gets ``line_matches`` (trimmed lineCode equals
    the trimmed code line at that number)."""
    cl = lines_l2(code)
    n = F.size(cl)
    kept = F.filter(_c(lines), lambda l: (l["lineNum"] >= 1) & (l["lineNum"] <= n))
    return F.transform(kept, lambda l: F.struct(
        l["lineNum"].alias("lineNum"), l["lineCode"].alias("lineCode"),
        (py_strip(l["lineCode"]) == py_strip(F.element_at(cl, l["lineNum"]))).alias("line_matches")))


def guard_fix(fix, code) -> Column:
    """V3: the fix (default: the original) is replaced by the original when
    its L2 line count differs."""
    f = F.coalesce(_c(fix), _c(code))
    return F.when(F.size(lines_l2(f)) != F.size(lines_l2(code)), _c(code)).otherwise(f)


def with_defaults(verdict: str, language, code) -> Column:
    """V4: field defaults for a parsed verdict, the failure record for an
    unparsed one. Returns struct like VERDICT (riskLevel raw string)."""
    v = F.col(verdict)
    ok = F.struct(
        _c(language).alias("language"),
        F.coalesce(v["is_vulnerability"], F.lit(False)).alias("is_vulnerability"),
        F.coalesce(v["vulnerabilityType"], F.lit("")).alias("vulnerabilityType"),
        v["cwe"].alias("cwe"),
        F.coalesce(clip_lines(v["vulnerabilityLines"], code),
                   F.array().cast("array<struct<lineNum:int,lineCode:string,line_matches:boolean>>")).alias("vulnerabilityLines"),
        F.coalesce(v["riskLevel"], F.lit(DEFAULT_RISK)).alias("riskLevel"),
        F.coalesce(v["explanation"], F.lit("")).alias("explanation"),
        guard_fix(v["fixCode"], code).alias("fixCode"),
        F.lit(False).alias("failed"))
    bad = F.struct(
        _c(language).alias("language"), F.lit(False).alias("is_vulnerability"), F.lit("").alias("vulnerabilityType"),
        F.lit(None).cast("string").alias("cwe"),
        F.array().cast("array<struct<lineNum:int,lineCode:string,line_matches:boolean>>").alias("vulnerabilityLines"),
        F.lit(FAILED_RISK).alias("riskLevel"), F.lit(FAILED_EXPLANATION).alias("explanation"),
        _c(code).alias("fixCode"), F.lit(True).alias("failed"))
    return F.when(v.isNull(), bad).otherwise(ok)


# ------------------------------------------------------------------ U1 verdict function slot

def default_verdict_fn(batches):
    """Deterministic stand-in for the model call (pandas, one Arrow batch at
    a time): a verdict built from the rule findings of the request.
    Input columns: work_key, lang, code, findings_json. Output: VERDICT_OUT."""
    import json

    import pandas as pd
    sev_rank = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
    for pdf in batches:
        rows = []
        for key, lang, fj in zip(pdf["work_key"], pdf["lang"], pdf["findings_json"]):
            fs = json.loads(fj) if fj else []
            flagged = [f for f in fs if f.get("cwe")]
            top = max(flagged, key=lambda f: (sev_rank.get(f.get("severity"), 0), -f["line"])) if flagged else None
            rows.append({
                "work_key": key, "language": lang, "is_vulnerability": bool(flagged),
                "cwe": top["cwe"] if top else "",
                "n_lines": len(flagged),
                "severity": top["severity"] if top else "info",
                "explanation": "; ".join(f["message"] for f in flagged) if flagged else "no rule finding",
                "lines": sorted({f["line"] for f in flagged}), "fix": None, "error": None,
            })
        yield pd.DataFrame(rows)


VERDICT_OUT = ("work_key string, language string, is_vulnerability boolean, cwe string, n_lines int, "
               "severity string, explanation string, lines array<int>, fix string, error string")


def failure_record(error: Column) -> dict[str, Column]:
    """V4 for a call that failed: the columns of VERDICT_OUT but for the key, with the error."""
    return {"language": F.lit(None).cast("string"), "is_vulnerability": F.lit(False), "cwe": F.lit(""), "n_lines": F.lit(0),
            "severity": F.lit("info"), "explanation": F.lit(FAILED_EXPLANATION), "lines": F.array().cast("array<int>"),
            "fix": F.lit(None).cast("string"), "error": error}


def _answers(fn, schema: str = VERDICT_OUT):
    """``fn`` over Arrow batches so that no call fails its task: a batch that raises is called again row by row, and
    the rows that raise alone, or get no answer, yield their key and an error."""
    names = [c.split()[0] for c in schema.split(", ")]

    def call(pdf):
        import pandas as pd
        try:
            got = pd.concat([*fn(iter([pdf])), pd.DataFrame(columns=["work_key"])]).reindex(columns=names)
            got = got[got["work_key"].isin(pdf["work_key"])].drop_duplicates("work_key")
        except Exception as e:
            if len(pdf) > 1:
                return [x for i in range(len(pdf)) for x in call(pdf.iloc[i:i + 1])]
            return [failed(pdf["work_key"], f"{type(e).__name__}: {e}")]
        return [got, failed(pdf["work_key"][~pdf["work_key"].isin(got["work_key"])], "no answer")]

    def failed(keys, error):
        import pandas as pd
        return pd.DataFrame({"work_key": keys, "error": error}).reindex(columns=names)

    def run(batches):
        for pdf in batches:
            for out in call(pdf):
                if len(out):
                    yield out.astype(object).where(out.notna(), None)
    return run


def findings_for_fn(findings) -> Column:
    """Compact JSON of the findings handed to the verdict function."""
    return F.to_json(F.transform(_c(findings), lambda f: F.struct(
        f["check_id"].alias("check_id"), f["line_no"].alias("line"), f["message"].alias("message"),
        f["cwe"].alias("cwe"), f["severity"].alias("severity"))))


def _by_key(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the work key by shuffle. Requests and answers hold whole texts, which Spark guesses from the few columns that they are
    made of: it would send millions of them through the driver to broadcast them."""
    return left.hint("merge").join(right.hint("merge"), "work_key", how)


def run_verdicts(requests: DataFrame, fn=default_verdict_fn, parallelism: int | None = None, cache: DataFrame | None = None) -> DataFrame:
    """One verdict (VERDICT_OUT and ``code``) per distinct work key of ``requests`` (work_key, lang, findings_json, code).

    ``fn`` takes an iterator of pandas frames and yields frames of VERDICT_OUT's columns (missing ones are null); it is
    called once per Arrow batch, so it should keep what is costly to load in its module. Keys that ``cache`` (columns of
    VERDICT_OUT) answers without an error are not called. A call that raises or gives no answer becomes a failure record
    with its ``error``. Of requests with one key the lowest language, findings and code count. ``parallelism`` bounds
    concurrent calls when the function hits a rate-limited service; Spark task retries replace the retry decorator."""
    distinct = requests.groupBy("work_key").agg(*[F.min(c).alias(c) for c in ("lang", "findings_json", "code")])
    names = [c.split()[0] for c in VERDICT_OUT.split(", ")]
    todo, known = distinct, None
    if cache is not None:
        answered = cache.where("error is null and work_key is not null").select(*names).dropDuplicates(["work_key"])
        known = _by_key(distinct.select("work_key", "code"), answered)
        todo = _by_key(distinct, answered.select("work_key"), "left_anti")
    if parallelism:
        todo = todo.repartition(parallelism, "work_key")
    out = todo.mapInPandas(_answers(fn), VERDICT_OUT)
    record = failure_record(F.col("error"))
    out = out.select("work_key", *[F.when(F.col("error").isNotNull(), c).otherwise(F.col(n)).alias(n) for n, c in record.items()])
    out = _by_key(todo.select("work_key", "code"), out)
    return out if known is None else out.unionByName(known)


def scan_verdicts(requests: DataFrame, keys: list[str], fn=default_verdict_fn,
                  parallelism: int | None = None, cache: DataFrame | None = None) -> DataFrame:
    """U1 end to end: the request table (keys, lang, work_key, findings_json,
    code) is written once to the shared checkpoint folder, so the expensive call
    and the join back read the same rows (no recomputation of the rule scan,
    and a retried task never re-derives its requests); verdicts are computed
    per distinct work key and joined back to every request. Every request gets a row:
    a failed call has ``error`` set and V4's defaults."""
    from ..session import checkpoint_dir
    checkpoint_dir(requests.sparkSession)
    if "code" not in requests.columns:
        requests = requests.withColumn("code", F.lit(None).cast("string"))
    req = requests.select(*keys, "lang", "work_key", "findings_json", "code").checkpoint(eager=True)
    out = run_verdicts(req, fn, parallelism, cache)
    return _by_key(req.select(*keys, "work_key"), out)


# ------------------------------------------------------------------ requests with context, answered in text

REPLY_OUT = "work_key string, reply string, error string"


def default_reply_fn(batches):
    """Deterministic stand-in for a model that answers in text: reports the pattern lines of the request's context.
    Input columns: work_key, request. Output: REPLY_OUT."""
    import json
    import re

    import pandas as pd
    for pdf in batches:
        replies = []
        for request in pdf["request"]:
            known, code = request.split("\n\n### Code:\n", 1)
            lines = re.findall(r"^- Pattern match at line (\d+): (.*) \(Risk: \w+\)$", known, re.M)
            verdict = {"language": "", "is_vulnerability": bool(lines), "vulnerabilityType": "pattern" if lines else "", "cwe": "",
                       "vulnerabilityLines": [{"lineNum": int(n), "lineCode": c} for n, c in lines],
                       "riskLevel": "high" if lines else "none", "explanation": f"{len(lines)} known pattern(s)", "fixCode": code}
            replies.append(f"The result is {json.dumps(verdict)} as asked.")
        yield pd.DataFrame({"work_key": pdf["work_key"], "reply": replies, "error": None})


def review_with_context(files: DataFrame, context: DataFrame, keys: list[str], lang: str, code: str,
                        fn=default_reply_fn, parallelism: int | None = None) -> DataFrame:
    """Retrieval flow: context (``keys``, context; X7) -> request (P7) -> one reply per distinct request (U1) -> parse (V1),
    validation (V6), clipped lines, guarded fix and defaults (V2-V4). One row per file, without context too:
    (keys, record, accepted, reason, risk_score, error). A call that fails or a reply without one JSON
    object gives V4's failure record; ``error`` tells them apart. ``fn`` takes frames (work_key, request) and yields REPLY_OUT."""
    from ..functions.lines import _col
    from ..session import checkpoint_dir
    from .rules import build_context_request
    checkpoint_dir(files.sparkSession)
    req = files.select(*keys, _col(lang).alias("_lang"), _col(code).alias("_code")).join(context.select(*keys, "context"), keys, "left")
    # written once: the calls and the join back read the same rows
    req = req.withColumn("request", build_context_request("_lang", "_code", "context"))
    req = req.select(*keys, "_lang", "_code", "request", F.sha2("request", 256).alias("work_key")).checkpoint(eager=True)
    todo = req.where("work_key is not null").groupBy("work_key").agg(F.min("request").alias("request"))
    if parallelism:
        todo = todo.repartition(parallelism, "work_key")
    replies = todo.mapInPandas(_answers(fn, REPLY_OUT), REPLY_OUT)
    d = with_parsed(_by_key(req.drop("request"), replies, "left"), "reply")
    valid = validate()
    return d.select(*keys, with_defaults("verdict", "_lang", F.col("_code")).alias("record"), valid["accepted"].alias("accepted"),
                    valid["reason"].alias("reason"), valid["risk_score"].alias("risk_score"), "error")
