"""Queries: embeddings, exact and approximate kNN, hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dims import FILTERED_TOP_K, KNOWLEDGE_BASE, RAG_TOP_K
from ..functions.lines import explode_rows
from ..operators import knn as K
from ..operators import rules as R
from ..operators import vectors as X
from ..operators import verdicts as V
from ..sources.tables import code_corpus, table
from .catalog import query
from .q_rules import PATTERNS_SQL
from .sqlparts import CC, pystrip, values

DIM = X.EMBED_DIM


def _embed_sql(src: str, id_col: str, text: str, out: str) -> str:
    """CTE ``out``(id, vec list<double>) of the hashed-token embedding."""
    return f"""{out}_t AS (SELECT {id_col} AS id, unnest(regexp_extract_all(lower({text}), '{X.TOKEN_RE}')) AS tok FROM {src}),
{out}_b AS (SELECT id, ('0x' || substr(sha256(tok), 1, 8))::BIGINT % {DIM} AS dim FROM {out}_t),
{out}_n AS (SELECT id, count(*) AS n FROM {out}_b GROUP BY id),
{out}_c AS (SELECT id, dim, count(*) AS c FROM {out}_b GROUP BY ALL),
{out}_g AS (SELECT n.id, n.n, r.range AS dim FROM {out}_n n CROSS JOIN range({DIM}) r),
{out}_v AS (SELECT g.id, g.dim, coalesce(c.c, 0) / g.n AS v FROM {out}_g g LEFT JOIN {out}_c c ON c.id = g.id AND c.dim = g.dim),
{out} AS (SELECT id, list(v ORDER BY dim) AS vec FROM {out}_v GROUP BY id)"""


@query("embed_docs", f"""WITH {_embed_sql('documents', 'doc_id', 'text', 'emb')}
SELECT id AS doc_id, CAST(dim AS INTEGER) AS dim, round(v, 6) AS value FROM emb_v""")
def q_embed_docs(spark, sf_dir):
    d = X.embedding_table(table(spark, sf_dir, "documents"), "doc_id", "text").select(
        "doc_id", F.posexplode("embedding").alias("dim", "v"))
    return d.select("doc_id", F.col("dim").cast("int").alias("dim"), F.round("v", 6).alias("value"))


def _knn_sql(k: int, same_label: bool) -> str:
    cond = "WHERE a.label = b.label" if same_label else ""
    return f"""WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
    list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i:
        (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) * (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))) AS d2
  FROM embeddings a JOIN embeddings b ON true {cond}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, neighbor_id) AS rk FROM d)
SELECT query_id, CAST(rk AS INTEGER) AS rank, neighbor_id, round(sqrt(d2), 6) AS dist FROM r WHERE rk <= {k}"""


@query("knn_l2", _knn_sql(RAG_TOP_K, False))
def q_knn_l2(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return K.knn_exact(e, "vec_id", "embedding", RAG_TOP_K)


@query("knn_filtered", _knn_sql(FILTERED_TOP_K, True))
def q_knn_filtered(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return K.knn_exact(e, "vec_id", "embedding", FILTERED_TOP_K, group_col="label")


#: Every so many ids are the queries of the approximate search.
QUERY_STEP = 50


@query("knn_approximate")
def q_knn_approximate(spark, sf_dir):
    """The nearest vectors of every vector whose id is divisible by 50, among all vectors, from inverted lists."""
    e = table(spark, sf_dir, "embeddings")
    return K.knn_approximate(e, "vec_id", "embedding", RAG_TOP_K, queries=e.where(F.col("vec_id") % QUERY_STEP == 0))


KB_SQL = values([(r[0], r[1], r[2], r[3], r[4]) for r in KNOWLEDGE_BASE],
                ["kb_id", "text", "language", "vulnerability_type", "risk_level"])

HYBRID_SQL = f"""{CC}, kb AS (SELECT * FROM {KB_SQL}),
{_embed_sql('cc', 'file_id', 'code', 'ce')},
{_embed_sql('kb', 'kb_id', 'text', 'ke')},
sem0 AS (SELECT cc.file_id, kb.kb_id, kb.vulnerability_type, kb.text, kb.risk_level,
    sqrt(list_sum(list_transform(range(1, {DIM} + 1), lambda i: (ce.vec[i] - ke.vec[i]) * (ce.vec[i] - ke.vec[i])))) AS d
  FROM cc JOIN kb ON kb.language = cc.lang JOIN ce ON ce.id = cc.file_id JOIN ke ON ke.id = kb.kb_id),
sem AS (SELECT file_id, 0 AS src, rk AS o1, '' AS o2, vulnerability_type || chr(1) || text AS k, 'semantic' AS kind, text, risk_level
        FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY d, kb_id) AS rk FROM sem0) WHERE rk <= 3),
pl AS (SELECT file_id, lang, unnest(string_split(code, chr(10))) AS line,
              CAST(generate_subscripts(string_split(code, chr(10)), 1) AS INTEGER) AS line_no FROM cc),
ph AS (SELECT pl.file_id, p.pattern, pl.line_no, {pystrip('pl.line')} AS line_code
       FROM pl JOIN {PATTERNS_SQL} p ON p.language = pl.lang AND contains(pl.line, p.pattern)),
pat AS (SELECT file_id, 1 AS src, line_no AS o1, pattern AS o2, line_code || chr(1) || CAST(line_no AS VARCHAR) AS k, 'pattern' AS kind,
               'Pattern match at line ' || CAST(line_no AS VARCHAR) || ': ' || line_code AS text, 'High' AS risk_level FROM ph),
u AS (SELECT * FROM sem UNION ALL SELECT * FROM pat),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, k ORDER BY src, o2, o1) AS kk FROM u) WHERE kk = 1),
ctx AS (SELECT file_id, CAST(rk AS INTEGER) AS rank, kind, text, risk_level
        FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY src, o2, o1) AS rk FROM f) WHERE rk <= 5)"""


def _hybrid(spark, sf_dir):
    cc = X.with_embedding(code_corpus(spark, sf_dir), "code", "file_id")
    kb = X.with_embedding(R.kb_table(spark), "text", "kb_id")
    hits = explode_rows(cc.withColumn("hits", R.pattern_hits("code", "lang")), ["file_id"], "hits", "h") \
        .select("file_id", "h.pattern", "h.line_no", "h.line_code")
    return X.hybrid_context(cc.select("file_id", "lang", "embedding"), kb, hits)


@query("hybrid_retrieve", f"WITH {HYBRID_SQL} SELECT * FROM ctx")
def q_hybrid_retrieve(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@query("context_digest", f"""WITH {HYBRID_SQL}
SELECT file_id, string_agg('- ' || text || ' (Risk: ' || risk_level || ')', chr(10) ORDER BY rank) AS context FROM ctx GROUP BY file_id""")
def q_context_digest(spark, sf_dir):
    return X.context_digest(_hybrid(spark, sf_dir))


# ------------------------------------------------------------------ X5: retrieval flow over real tables

# chunk numbers are ints, so no two chunks share an id
CHUNK_ID_BASE = 1 << 31


def _rag_texts(spark, sf_dir):
    from ..operators import chunking as C
    docs = C.with_fixed_line_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    chunks = explode_rows(docs, ["doc_id"], "chunks", "c").select(
        (F.col("doc_id") * CHUNK_ID_BASE + F.col("c.chunk_no")).alias("chunk_id"), "doc_id",
        F.col("c.chunk_no").alias("chunk_no"), F.col("c.text").alias("text"))
    corpus = X.embedding_table(chunks, "chunk_id", "text")
    queries = X.embedding_table(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), "text"),
                                "chunk_id", "text")
    top = K.knn_exact(corpus, "chunk_id", "embedding", RAG_TOP_K, queries=queries)
    # Neighbour position -> chunk text and its document
    return (top.join(chunks.withColumnRenamed("chunk_id", "neighbor_id"), "neighbor_id")
            .select(F.col("query_id").alias("item_id"), "rank", "doc_id", "chunk_no", "dist", "text"))


RAG_SQL = f"""l AS (SELECT doc_id, string_split(text, chr(10)) AS l2 FROM documents),
x AS (SELECT doc_id, unnest(l2) AS line, generate_subscripts(l2, 1) AS i, len(l2) AS n2 FROM l),
y AS (SELECT doc_id, i, CASE WHEN i < n2 THEN line || chr(10) ELSE line END AS lt FROM x),
chunks AS (SELECT doc_id * {CHUNK_ID_BASE} + (i - 1) // 20 AS chunk_id, doc_id, CAST((i - 1) // 20 AS INTEGER) AS chunk_no,
                  string_agg(lt, '' ORDER BY i) AS text FROM y WHERE lt <> '' GROUP BY doc_id, (i - 1) // 20),
bq AS (SELECT item_id, text FROM benchmark),
{_embed_sql('chunks', 'chunk_id', 'text', 'ce')},
{_embed_sql('bq', 'item_id', 'text', 'qe')},
d AS (SELECT qe.id AS item_id, ce.id AS chunk_id,
        list_sum(list_transform(range(1, {DIM} + 1), lambda i: (qe.vec[i] - ce.vec[i]) * (qe.vec[i] - ce.vec[i]))) AS d2
      FROM qe JOIN ce ON true),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY d2, chunk_id) AS rk FROM d),
rag AS (SELECT r.item_id, CAST(r.rk AS INTEGER) AS rank, c.doc_id, c.chunk_no, round(sqrt(r.d2), 6) AS dist, c.text
        FROM r JOIN chunks c ON c.chunk_id = r.chunk_id WHERE r.rk <= {RAG_TOP_K})"""


@query("rag_retrieve", f"WITH {RAG_SQL} SELECT item_id, rank, doc_id, chunk_no, dist, sha256(text) AS chunk_hash FROM rag")
def q_rag_retrieve(spark, sf_dir):
    return _rag_texts(spark, sf_dir).select("item_id", "rank", "doc_id", "chunk_no", "dist", F.sha2("text", 256).alias("chunk_hash"))


# ------------------------------------------------------------------ requests with context (P7) and their answers

@query("snippet_requests", f"""WITH {RAG_SQL}
SELECT b.item_id, CAST(count(rag.rank) AS INTEGER) AS n_chunks,
  sha256('Name the language of this snippet and review each of its functions for security weaknesses. '
    || 'Give the weakness type, affected lines with numbers, the risk and the whole block with a fix, as one JSON object.'
    || chr(10) || chr(10) || '### Snippet:' || chr(10) || any_value(b.text) || chr(10) || chr(10) || '### From source files:' || chr(10)
    || coalesce(string_agg(rag.text, chr(10) || chr(10) ORDER BY rag.rank), '')) AS request_hash
FROM benchmark b LEFT JOIN rag ON rag.item_id = b.item_id GROUP BY b.item_id""")
def q_snippet_requests(spark, sf_dir):
    """X5 -> P7: every benchmark text as a snippet, with its three nearest chunks of the documents (at most three a snippet)."""
    near = _rag_texts(spark, sf_dir).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("near"))
    items = table(spark, sf_dir, "benchmark").select("item_id", "text").join(near, "item_id", "left")
    chunks = F.coalesce(F.transform("near", lambda x: x["text"]), F.array().cast("array<string>"))
    return items.select("item_id", F.size(chunks).alias("n_chunks"), F.sha2(R.build_snippet_request("text", chunks), 256).alias("request_hash"))


@query("context_requests", f"""WITH {HYBRID_SQL},
cd AS (SELECT file_id, string_agg('- ' || text || ' (Risk: ' || risk_level || ')', chr(10) ORDER BY rank) AS context FROM ctx GROUP BY file_id)
SELECT cc.file_id, 'Review this ' || lang || ' code for security weaknesses with the help of what is known about similar code.'
  || chr(10) || chr(10) || '### Known:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || '### Code:' || chr(10) || code AS request
FROM cc LEFT JOIN cd ON cd.file_id = cc.file_id""")
def q_context_requests(spark, sf_dir):
    """X4 -> X7 -> P7 for every source file."""
    files = code_corpus(spark, sf_dir).join(X.context_digest(_hybrid(spark, sf_dir)), "file_id", "left")
    return files.select("file_id", R.build_context_request("lang", "code", "context").alias("request"))


@query("review_with_context", f"""WITH {HYBRID_SQL},
pn AS (SELECT file_id, count(*) AS n FROM ctx WHERE kind = 'pattern' GROUP BY file_id)
SELECT cc.file_id, lang, n IS NOT NULL AS is_vulnerability, CAST(coalesce(n, 0) AS INTEGER) AS n_lines, CAST(coalesce(n, 0) AS INTEGER) AS n_matching,
       CAST(CASE WHEN n IS NULL THEN 0 ELSE 7 END AS DOUBLE) AS risk_score, coalesce(n, 0) || ' known pattern(s)' AS explanation, sha256(code) AS fix_hash, false AS failed
FROM cc LEFT JOIN pn ON pn.file_id = cc.file_id""")
def q_review_with_context(spark, sf_dir):
    """X4 -> X7 -> P7 -> U1 -> V1-V6 for every source file, with the stand-in for the model."""
    files = code_corpus(spark, sf_dir)
    out = V.review_with_context(files, X.context_digest(_hybrid(spark, sf_dir)), ["file_id"], "lang", "code")
    lines = F.col("record.vulnerabilityLines")
    return out.select("file_id", F.col("record.language").alias("lang"), "record.is_vulnerability", F.size(lines).alias("n_lines"),
                      F.size(F.filter(lines, lambda l: l["line_matches"])).alias("n_matching"), "risk_score", "record.explanation",
                      F.sha2("record.fixCode", 256).alias("fix_hash"), "record.failed")


# ------------------------------------------------------------------ U2: a user's encoder

def _letter_shares():
    """A small encoder: the share of each letter a to h among a text's characters."""
    def encode(texts):
        return [[t.count(c) / max(len(t), 1) for c in "abcdefgh"] for t in texts]
    return encode


@query("encode_by_user_model", """SELECT doc_id, CAST(i - 1 AS INTEGER) AS dim,
  round((length(t) - length(replace(t, chr(CAST(96 + i AS INTEGER)), ''))) / greatest(length(t), 1), 6) AS value
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), range(1, 9) r(i)""")
def q_encode_by_user_model(spark, sf_dir):
    """Every document by an encoder that the user passes in."""
    enc = X.encoder_udf(_letter_shares, 8)
    d = table(spark, sf_dir, "documents").select("doc_id", enc("text").alias("v"))
    return d.select("doc_id", F.posexplode("v").alias("dim", "v")).select("doc_id", "dim", F.round("v", 6).alias("value"))
