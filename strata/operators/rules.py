"""Rule scan over lines (R1-R5), findings JSON (K2), work key (H2) and
request text (P7).

Design: a file/document is one row. The rule table and the pattern lists
are small fixed dimensions, so every rule becomes a *literal* regex inside
a higher-order ``filter`` over the row's line array: patterns are compiled
once per task, only matching lines are materialised, and there is no join
and no shuffle. Exploding happens after matching, on the (few) hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import KNOWLEDGE_BASE, NO_DESCRIPTION, RULE_HINTS, RULES, SEVERITY_SCORE, UNKNOWN_LINE
from ..functions.lines import explode_rows, lines_l2, py_strip


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def indexed_lines(text) -> Column:
    """array<struct<line_no int, line string>> under the L2 model (1-based)."""
    return F.transform(lines_l2(text), lambda l, i: F.struct((i + 1).alias("line_no"), l.alias("line")))


def _matches(regex, hint=None):
    """Line predicate: literal prefilter (cheap ``contains``) then the regex."""
    if not hint:
        return lambda x: x["line"].rlike(regex)
    ci, lits = hint

    def pred(x):
        line = F.lower(x["line"]) if ci else x["line"]
        pre = None
        for lit in lits:
            c = line.contains(lit)
            pre = c if pre is None else (pre | c)
        return pre & x["line"].rlike(regex)
    return pred


def _finding(rule_id, message, cwe, severity):
    return lambda x: F.struct(
        x["line_no"].alias("line_no"), F.lit(rule_id).alias("check_id"),
        F.lit(message).cast("string").alias("message"), F.lit(cwe).cast("string").alias("cwe"),
        F.lit(severity).alias("severity"))


def _contains(p):
    return lambda x: x["line"].contains(p)


def _pattern_hit(p):
    return lambda x: F.struct(F.lit(p).alias("pattern"), x["line_no"].alias("line_no"),
                              py_strip(x["line"]).alias("line_code"))


def findings_array(text, lang, rules=RULES, idx: Column | None = None) -> Column:
    """All (rule, line) hits of one text, ordered by (line_no, check_id).

    Element: struct<line_no int, check_id string, message string, cwe string,
    severity string>. Rules with language '*' apply to every text.
    """
    idx = indexed_lines(text) if idx is None else idx
    parts = []
    empty = F.array().cast("array<struct<line_no:int,check_id:string,message:string,cwe:string,severity:string>>")
    for rule_id, rlang, regex, message, cwe, severity in rules:
        hits = F.transform(F.filter(idx, _matches(regex, RULE_HINTS.get(rule_id))),
                           _finding(rule_id, message, cwe, severity))
        if rlang != "*":
            hits = F.when(_c(lang) == F.lit(rlang), hits).otherwise(empty)
        parts.append(hits)
    return F.array_sort(F.concat(*parts))


def with_findings(df: DataFrame, text: str, lang: str) -> DataFrame:
    """Adds ``findings``; the indexed line array is a column of its own so
    the text is split once per row, not once per rule."""
    d = df.withColumn("_idx", indexed_lines(text))
    return d.withColumn("findings", findings_array(None, lang, idx=F.col("_idx"))).drop("_idx")


def explode_findings(df: DataFrame, keys: list[str]) -> DataFrame:
    """R3 as rows: one row per hit."""
    return explode_rows(df, keys, "findings", "f").select(
        *keys, "f.line_no", "f.check_id", "f.message", "f.cwe", "f.severity")


def findings_digest(findings) -> Column:
    """Text digest of the findings, defaults for missing message/line."""
    return F.array_join(F.transform(_c(findings), lambda f: F.concat(
        F.lit("- Rule: "), f["check_id"], F.lit("\n  - Issue: "),
        F.coalesce(f["message"], F.lit(NO_DESCRIPTION)), F.lit("\n  - Line: "),
        F.coalesce(f["line_no"].cast("string"), F.lit(UNKNOWN_LINE)), F.lit("\n"))), "")


def findings_json(findings) -> Column:
    """K2: findings as compact JSON ``[{"check_id":..,"start":{"line":..},"extra":{"message":..}}]``."""
    return F.to_json(F.transform(_c(findings), lambda f: F.struct(
        f["check_id"].alias("check_id"), F.struct(f["line_no"].alias("line")).alias("start"),
        F.struct(f["message"].alias("message")).alias("extra"))))


def work_key(code, findings) -> Column:
    """H2: sha256 of the code followed by the findings JSON ('[]' when none)."""
    return F.sha2(F.concat(_c(code), findings_json(findings)), 256)


def severity_score(sev) -> Column:
    m = F.create_map(*[F.lit(x) for kv in SEVERITY_SCORE.items() for x in kv])
    return F.try_element_at(m, _c(sev))


def scan_with_findings(df: DataFrame, text: str, lang: str, keys: list[str]) -> DataFrame:
    """Every file goes on; files with findings carry their digest."""
    f = with_findings(df, text, lang)
    n = F.size("findings")
    return f.select(*keys, lang, n.cast("bigint").alias("n_findings"), (n > 0).alias("has_findings"),
                    F.when(n > 0, F.concat(F.lit("\n\n### Rule findings:\n"), findings_digest("findings")))
                    .otherwise(F.lit("")).alias("digest"))


def build_request(lang, code, digest) -> Column:
    """Request text for the verdict function (own wording)."""
    return F.concat(
        F.lit("Review the following "), _c(lang), F.lit(" code for security weaknesses. "),
        F.lit("Report the weakness type, CWE id, affected lines with numbers, a risk score 0-10, "),
        F.lit("an explanation and the whole block with a fix, as one JSON object."),
        F.lit("\n\n### Code:\n"), _c(code), _c(digest))


def build_context_request(lang, code, context) -> Column:
    """P7 with retrieved knowledge (X7): the context goes first, the code last."""
    return F.concat(
        F.lit("Review this "), _c(lang), F.lit(" code for security weaknesses with the help of what is known about similar code."),
        F.lit("\n\n### Known:\n"), F.coalesce(_c(context), F.lit("")), F.lit("\n\n### Code:\n"), _c(code))


def build_snippet_request(code, chunks) -> Column:
    """P7 for a snippet with chunks of source files (X5), nearest first."""
    return F.concat(
        F.lit("Name the language of this snippet and review each of its functions for security weaknesses. "),
        F.lit("Give the weakness type, affected lines with numbers, the risk and the whole block with a fix, as one JSON object."),
        F.lit("\n\n### Snippet:\n"), _c(code), F.lit("\n\n### From source files:\n"), F.array_join(_c(chunks), "\n\n"))


# ---------------------------------------------------------------- knowledge base patterns

def kb_table(spark) -> DataFrame:
    """The knowledge base as a small DataFrame (broadcast where joined)."""
    return spark.createDataFrame(
        KNOWLEDGE_BASE,
        "kb_id int, text string, language string, vulnerability_type string, risk_level string, "
        "remediation string, example_fix string, patterns array<string>")


def kb_patterns(spark) -> DataFrame:
    """R2: distinct patterns per language, deterministic order."""
    return (kb_table(spark).select("language", F.explode("patterns").alias("pattern"))
            .distinct())


def patterns_by_lang() -> dict[str, list[str]]:
    out: dict[str, set] = {}
    for row in KNOWLEDGE_BASE:
        out.setdefault(row[2], set()).update(row[7])
    return {k: sorted(v) for k, v in out.items()}


def pattern_hits(text, lang) -> Column:
    """Every (pattern, line) hit: literal ``contains`` per pattern, the
    pattern list chosen by the row's language; ordered by (pattern, line)."""
    idx = indexed_lines(text)
    empty = F.array().cast("array<struct<pattern:string,line_no:int,line_code:string>>")
    out = empty
    for plang, pats in sorted(patterns_by_lang().items()):
        arrs = [F.transform(F.filter(idx, _contains(p)), _pattern_hit(p)) for p in pats]
        out = F.when(_c(lang) == plang, F.concat(*arrs)).otherwise(out)
    return out
