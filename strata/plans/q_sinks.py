"""Queries: result envelope per source (K3) and the extension predicate (S3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dims import SCAN_EXTENSIONS
from ..operators import rules as R
from ..operators.langs import guess_lang, marker_tokens
from ..operators.sinks import read_index, read_results, result_envelope, save_results, write_index
from ..session import scratch_path
from ..sources.tables import corpus_paths, table
from .catalog import query
from .q_langs import GUESS_SQL
from .q_rules import RULES_SQL
from .sqlparts import CP, values

EXT_SQL = values([(e,) for e in SCAN_EXTENSIONS], ["ext"])


@query("result_envelope", f"""WITH {GUESS_SQL},
hl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
fl AS (SELECT DISTINCT hl.doc_id FROM hl JOIN {RULES_SQL} r ON r.rlang = '*' AND r.cwe IS NOT NULL AND regexp_matches(hl.line, r.regex)),
rows AS (SELECT d.source, g.guess IS NULL AS failed, fl.doc_id IS NOT NULL AS flagged
         FROM documents d JOIN guess g ON g.doc_id = d.doc_id LEFT JOIN fl ON fl.doc_id = d.doc_id)
SELECT source, CASE WHEN count(*) FILTER (WHERE failed) = 0 THEN 'SUCCESS' ELSE 'FAILURE' END AS status,
       CAST(count(*) AS BIGINT) AS n_results, CAST(count(*) FILTER (WHERE flagged) AS BIGINT) AS n_flagged,
       CAST(count(*) FILTER (WHERE failed) AS BIGINT) AS n_rejects,
       CASE WHEN count(*) FILTER (WHERE failed) > 0 THEN CAST(count(*) FILTER (WHERE failed) AS VARCHAR) || ' result(s) failed' END AS error
FROM rows GROUP BY source""")
def q_result_envelope(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    d = docs.withColumn("_tok", marker_tokens("text")).withColumn("guess", guess_lang("_tok"))
    d = R.with_findings(d, "text", "lang")
    rows = d.select("source", F.col("guess").isNull().alias("failed"),
                    F.exists("findings", lambda f: f["cwe"].isNotNull()).alias("flagged"))
    return result_envelope(rows, "source", "failed", "flagged")


@query("filter_supported", f"""WITH {CP}
SELECT file_id, file_path FROM cp WHERE EXISTS (SELECT 1 FROM {EXT_SQL} e WHERE ends_with(cp.file_path, e.ext))""")
def q_filter_supported(spark, sf_dir):
    cp = corpus_paths(spark, sf_dir)
    cond = F.lit(False)
    for e in SCAN_EXTENSIONS:
        cond = cond | F.col("file_path").endswith(e)
    return cp.filter(cond).select("file_id", "file_path")


@query("results_round_trip", f"""WITH {CP}
SELECT file_id, file_path, lang, sha256(code) AS hash, CAST(length(code) AS BIGINT) AS n_chars,
       CAST(len(string_split(code, chr(10))) AS BIGINT) AS n_lines FROM cp""")
def q_results_round_trip(spark, sf_dir):
    """Rows with nested structs, written as JSON by the tasks to the shared folder and read again."""
    cp = corpus_paths(spark, sf_dir)
    rows = cp.select("file_id", "file_path", "lang", F.struct(F.sha2("code", 256).alias("hash"), F.length("code").alias("n_chars")).alias("code"),
                     F.transform(F.split("code", "\n"), lambda l, i: F.struct((i + 1).alias("line"), l.alias("text"))).alias("lines"))
    path = scratch_path(spark, "results")
    save_results(rows, path)
    back = read_results(spark, path, envelope=False)
    return back.select("file_id", "file_path", "lang", "code.hash", "code.n_chars", F.size("lines").cast("bigint").alias("n_lines"))


@query("index_read_back", """SELECT label, CAST(count(*) AS BIGINT) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id,
  round(sum(CAST(embedding[1] AS DOUBLE)), 3) AS first_sum FROM embeddings WHERE label % 2 = 1 GROUP BY label""")
def q_index_read_back(spark, sf_dir):
    """K4: the vectors written in partitions by label, and the odd labels read back (the others' folders aren't opened)."""
    path = scratch_path(spark, "index")
    write_index(table(spark, sf_dir, "embeddings"), path, "label")
    odd = read_index(spark, path).where("label % 2 = 1")
    return odd.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"),
        F.round(F.sum(F.col("embedding")[0].cast("double")), 3).alias("first_sum"))
