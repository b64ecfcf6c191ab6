"""Queries: language classification, hashing and normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dims import EXT_LANG, KINDS_BY_LANG, LANG_MARKERS, RULESET_BY_LANG
from ..functions.lines import normalize_text
from ..operators import langs
from ..sources.tables import code_corpus, corpus_paths, table
from .catalog import query
from .sqlparts import CC, CP, l1, pystrip, values

EXT_SQL = values(sorted(EXT_LANG.items()), ["ext", "lang"])
MARKERS_SQL = values(LANG_MARKERS, ["mlang", "tok"])
RULESET_SQL = values(sorted(RULESET_BY_LANG.items()), ["rlang", "ruleset"])
KINDS_SQL = values([(k, x) for k, v in KINDS_BY_LANG.items() for x in v], ["klang", "kind"])

LANG_BY_EXT_SQL = f"""
WITH {CP},
b AS (SELECT file_id, file_path, ltrim(regexp_extract(file_path, '[^/]*$', 0), '.') AS stem FROM cp),
e AS (SELECT file_id, file_path,
        CASE WHEN strpos(stem, '.') > 0 THEN '.' || string_split(stem, '.')[-1] ELSE '' END AS ext FROM b)
SELECT e.file_id, e.file_path, coalesce(m.lang, 'unknown') AS lang
FROM e LEFT JOIN {EXT_SQL} m ON m.ext = e.ext
WHERE coalesce(m.lang, 'unknown') <> 'unknown'
"""


@query("lang_by_ext", LANG_BY_EXT_SQL)
def q_lang_by_ext(spark, sf_dir):
    return langs.with_lang(corpus_paths(spark, sf_dir)).select("file_id", "file_path", "lang")


GUESS_SQL = f"""
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS tok FROM documents),
s AS (SELECT doc_id, m.mlang AS g, count(*) AS n FROM t JOIN {MARKERS_SQL} m ON m.tok = t.tok GROUP BY ALL),
r AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) AS rn FROM s),
guess AS (SELECT d.doc_id, d.lang, r.g AS guess FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND r.rn = 1)
"""


@query("lang_by_content", f"WITH {GUESS_SQL} SELECT doc_id, lang, guess FROM guess")
def q_lang_by_content(spark, sf_dir):
    return langs.lang_by_content(table(spark, sf_dir, "documents"))


_CONF_COLS = ", ".join(
    f"CAST(count(*) FILTER (WHERE guess = '{x}') AS BIGINT) AS n_{x}" for x in sorted({m[0] for m in LANG_MARKERS}))


@query("lang_confusion", f"""WITH {GUESS_SQL}
SELECT lang, {_CONF_COLS}, CAST(count(*) FILTER (WHERE guess IS NULL) AS BIGINT) AS n_none,
       CAST(count(*) AS BIGINT) AS n_docs
FROM guess GROUP BY lang""")
def q_lang_confusion(spark, sf_dir):
    return langs.lang_confusion(table(spark, sf_dir, "documents"))


@query("ruleset_for_lang", f"""WITH {CC},
u AS (SELECT 'doc' AS src, doc_id AS id, lang FROM documents UNION ALL SELECT 'code', file_id, lang FROM cc)
SELECT src, id, lang, coalesce(r.ruleset, 'auto') AS ruleset FROM u LEFT JOIN {RULESET_SQL} r ON r.rlang = lower(u.lang)""")
def q_ruleset_for_lang(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), "lang")
    c = code_corpus(spark, sf_dir).select(F.lit("code").alias("src"), F.col("file_id").alias("id"), "lang")
    return d.unionByName(c).withColumn("ruleset", langs.ruleset_for("lang"))


@query("supported_langs", f"""WITH x AS ({LANG_BY_EXT_SQL}),
k AS (SELECT klang, CAST(count(*) AS BIGINT) AS n_kinds FROM {KINDS_SQL} GROUP BY klang)
SELECT lang, CAST(count(*) AS BIGINT) AS n_files, any_value(k.n_kinds) AS n_kinds
FROM x JOIN k ON k.klang = x.lang GROUP BY lang""")
def q_supported_langs(spark, sf_dir):
    return langs.supported_langs(langs.with_lang(corpus_paths(spark, sf_dir)))


@query("hash_docs", "SELECT doc_id, sha256(text) AS hash, CAST(n_chars AS BIGINT) AS n_chars FROM documents")
def q_hash_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), "n_chars")


def _norm_sql(x: str) -> str:
    stripped_lines = f"list_transform({l1(pystrip(x))}, lambda s: {pystrip('s')})"
    return f"array_to_string(list_filter({stripped_lines}, lambda s: s <> ''), chr(10))"


@query("normalize_text", f"""WITH {CC}
SELECT 'doc' AS src, doc_id AS id, {_norm_sql('text')} AS normalized FROM documents
UNION ALL SELECT 'code', file_id, {_norm_sql('code')} FROM cc""")
def q_normalize_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"),
                                                 normalize_text("text").alias("normalized"))
    c = code_corpus(spark, sf_dir).select(F.lit("code").alias("src"), F.col("file_id").alias("id"),
                                          normalize_text("code").alias("normalized"))
    return d.unionByName(c)
