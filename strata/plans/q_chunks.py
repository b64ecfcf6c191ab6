"""Queries: chunkers and interval operators (C1-C5, C1b-C1d)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dims import FALLBACK_THRESHOLDS
from ..functions.lines import explode_rows, lines_l1, py_strip
from ..operators import blocks as B
from ..operators import chunking as C
from ..operators.splitter import with_recursive_pieces
from ..sources.tables import code_corpus, table
from .catalog import query
from .sqlparts import CC, l1, pylstrip, pystrip, values

THRESH_SQL = values(sorted(FALLBACK_THRESHOLDS.items()), ["tlang", "t"])
DELIM_SQL = "chr(10) || chr(10) || '-----' || chr(10) || chr(10)"


# ------------------------------------------------------------------ C3

@query("chunk_fixed_lines", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l2 FROM documents),
x AS (SELECT doc_id, unnest(l2) AS line, generate_subscripts(l2, 1) AS i, len(l2) AS n2 FROM l),
y AS (SELECT doc_id, i, CASE WHEN i < n2 THEN line || chr(10) ELSE line END AS lt FROM x)
SELECT doc_id, CAST((i - 1) // 20 AS INTEGER) AS chunk_no, CAST(min(i) AS INTEGER) AS start_line,
       CAST(max(i) AS INTEGER) AS end_line, sha256(string_agg(lt, '' ORDER BY i)) AS hash
FROM y WHERE lt <> '' GROUP BY doc_id, (i - 1) // 20""")
def q_chunk_fixed_lines(spark, sf_dir):
    d = C.with_fixed_line_chunks(table(spark, sf_dir, "documents"), "text")
    return (explode_rows(d, ["doc_id"], "chunks", "c")
            .select("doc_id", "c.chunk_no", "c.start_line", "c.end_line", F.sha2("c.text", 256).alias("hash")))


# ------------------------------------------------------------------ C2

def fallback_sql(src_cte: str) -> str:
    """Recursive-CTE oracle of the fallback fold. ``src_cte`` defines
    ``srcs(src, id, lang, text)``; yields CTE ``fb`` with one row per chunk."""
    return f"""{src_cte},
thr AS (SELECT s.src, s.id, s.text, coalesce(t.t, 50) AS t FROM srcs s LEFT JOIN {THRESH_SQL} t ON t.tlang = s.lang),
ll AS (SELECT src, id, t, {l1('text')} AS ls FROM thr),
lx AS (SELECT src, id, t, unnest(ls) AS line, generate_subscripts(ls, 1) AS phys FROM ll),
nb AS (SELECT src, id, t, phys, line, length(line) - length({pylstrip('line')}) AS ind,
              row_number() OVER (PARTITION BY src, id ORDER BY phys) AS o FROM lx WHERE {pystrip('line')} <> ''),
fold AS (SELECT src, id, o, 1 AS n, ind AS prev, (1 >= t) AS fl FROM nb WHERE o = 1
    UNION ALL
    SELECT nb.src, nb.id, nb.o, CASE WHEN fold.fl THEN 1 ELSE fold.n + 1 END, nb.ind,
           (CASE WHEN fold.fl THEN 1 ELSE fold.n + 1 END) >= nb.t
           OR ((CASE WHEN fold.fl THEN 1 ELSE fold.n + 1 END) >= 2 AND nb.ind < fold.prev)
    FROM fold JOIN nb ON nb.src = fold.src AND nb.id = fold.id AND nb.o = fold.o + 1),
fg AS (SELECT fold.src, fold.id, fold.o, nb.phys, nb.line,
          coalesce(sum(CAST(fold.fl AS INTEGER)) OVER (PARTITION BY fold.src, fold.id ORDER BY fold.o
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_no
       FROM fold JOIN nb ON nb.src = fold.src AND nb.id = fold.id AND nb.o = fold.o),
fb AS (SELECT src, id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(min(phys) AS INTEGER) AS start_line,
          CAST(max(phys) AS INTEGER) AS end_line, CAST(min(o) AS INTEGER) AS start_ord,
          CAST(max(o) AS INTEGER) AS end_ord, CAST(count(*) AS INTEGER) AS n_lines,
          string_agg(line, chr(10) ORDER BY o) AS text
       FROM fg GROUP BY src, id, chunk_no)"""


FB_SRC = f"""{CC},
srcs AS (SELECT 'doc' AS src, doc_id AS id, lang, text FROM documents
         UNION ALL SELECT 'page', page_id, 'html', html FROM pages
         UNION ALL SELECT 'code', file_id, lang, code FROM cc)"""


def _fb_sources(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), "lang", "text")
    p = table(spark, sf_dir, "pages").select(F.lit("page").alias("src"), F.col("page_id").alias("id"),
                                             F.lit("html").alias("lang"), F.col("html").alias("text"))
    c = code_corpus(spark, sf_dir).select(F.lit("code").alias("src"), F.col("file_id").alias("id"), "lang",
                                          F.col("code").alias("text"))
    return d.unionByName(p).unionByName(c)


@query("chunk_fallback", f"""WITH RECURSIVE {fallback_sql(FB_SRC)}
SELECT src, id, chunk_no, start_line, end_line, start_ord, end_ord, n_lines, sha256(text) AS hash FROM fb""", kind="R")
def q_chunk_fallback(spark, sf_dir):
    out = C.chunk_fallback(_fb_sources(spark, sf_dir), ["src", "id"], "text", "lang")
    return out.select("src", "id", "chunk_no", "start_line", "end_line", "start_ord", "end_ord", "n_lines", "hash")


# ------------------------------------------------------------------ C1

def blocks_sql(files_cte: str) -> str:
    """Oracle of C1 over ``files(file_id, lang, code)`` in python, c and javascript; yields CTE ``blk``. Every line that may begin a
    definition gets its extent from the lines behind it; those inside of another one go. No state is carried along."""
    quoted = "\"(?:[^\"\\\\\\n]|\\\\.)*\"|''(?:[^''\\\\\\n]|\\\\.)*''"
    return f"""{files_cte},
bt AS (SELECT file_id, lang, code, array_to_string(list_transform(CASE WHEN lang = 'python' THEN regexp_extract_all(code, '#[^\\n]*|{quoted}|[^"''#]+|(?s:.)')
           ELSE regexp_extract_all(code, '/\\*(?s:.*?)\\*/|//[^\\n]*|{quoted}|`[^`]*`|[^"''`/]+|(?s:.)') END, lambda t:
         CASE WHEN lang = 'python' AND t[1] = '#' OR lang <> 'python' AND t[1:2] IN ('/*', '//') THEN regexp_replace(t, '[^\\n]+', '', 'g')
              WHEN t[1] IN ('"', chr(39), '`') AND len(t) > 1 THEN regexp_replace(t, '[^\\n]+', '_', 'g') ELSE t END), '') AS clean FROM files),
bl AS (SELECT file_id, lang, unnest(string_split(clean, chr(10))) AS m, generate_subscripts(string_split(clean, chr(10)), 1) AS i FROM bt),
bd AS (SELECT *, {pystrip('m')} AS c, length(m) - length({pylstrip('m')}) AS ind,
              length(regexp_replace(m, '[^(\\[{{]', '', 'g')) - length(regexp_replace(m, '[^)\\]}}]', '', 'g')) AS delta FROM bl),
be AS (SELECT *, sum(delta) OVER (PARTITION BY file_id ORDER BY i) AS after FROM bd WHERE c <> ''),
bs AS (SELECT *, after - delta AS before,
         CASE lang WHEN 'python' THEN CASE WHEN c LIKE 'def %' THEN 'function_definition' WHEN c LIKE 'class %' THEN 'class_definition' END
                   WHEN 'javascript' THEN CASE WHEN c LIKE 'function %' THEN 'function' WHEN split_part(c, ' ', 1) IN ('const', 'let') THEN 'lexical_declaration' END
                   ELSE CASE WHEN c[1] = '#' OR split_part(c, ' ', 1) IN ('if', 'for', 'while', 'return', 'else') THEN NULL
                             WHEN regexp_matches(c, '^struct [A-Za-z]+ *[{{]') THEN 'struct_specifier'
                             WHEN regexp_matches(c, '^[a-z]+ [a-z0-9]+\\(') THEN 'function_definition' WHEN c[-1] = ';' THEN 'declaration' END END AS kind FROM be),
sp AS (SELECT s.file_id, s.kind, s.i AS first,
              min(n.i) FILTER (WHERE s.lang = 'python' AND n.i > s.i AND n.before = 0 AND n.ind <= s.ind) AS next,
              min(n.i) FILTER (WHERE s.lang <> 'python' AND n.after <= s.before AND n.c[-1] IN (';', '}}')) AS closing
       FROM bs s JOIN bs n ON n.file_id = s.file_id AND n.i >= s.i WHERE s.kind IS NOT NULL AND (s.lang <> 'python' OR s.before = 0) GROUP BY ALL),
bx AS (SELECT sp.file_id, sp.kind, sp.first, coalesce(closing, max(n.i)) AS last
       FROM sp JOIN bs n ON n.file_id = sp.file_id AND (next IS NULL OR n.i < next) GROUP BY sp.file_id, sp.kind, sp.first, closing),
bo AS (SELECT * FROM bx ANTI JOIN (SELECT i.file_id, i.first FROM bx i JOIN bx o ON o.file_id = i.file_id AND o.first < i.first AND o.last >= i.first) USING (file_id, first)),
blk AS (SELECT bo.file_id, CAST(row_number() OVER (PARTITION BY bo.file_id ORDER BY first) - 1 AS INTEGER) AS chunk_no, CAST(first AS INTEGER) AS start_line,
               CAST(last AS INTEGER) AS end_line, CAST(last - first + 1 AS INTEGER) AS n_lines, kind,
               array_to_string(string_split(code, chr(10))[first:last], chr(10)) AS text FROM bo JOIN files USING (file_id))"""


BLOCKS_ORACLE = f"""WITH RECURSIVE {blocks_sql(CC + ", files AS (SELECT file_id, lang, code FROM cc)")},
{fallback_sql("srcs AS (SELECT 'code' AS src, file_id AS id, lang, code AS text FROM files WHERE file_id NOT IN (SELECT file_id FROM blk))")}
SELECT file_id, chunk_no, start_line, end_line, n_lines, kind, sha256(text) AS hash FROM blk
UNION ALL SELECT id, chunk_no, start_line, end_line, n_lines, NULL, sha256(text) FROM fb"""


@query("chunk_blocks", BLOCKS_ORACLE, kind="R")
def q_chunk_blocks(spark, sf_dir):
    out = B.block_chunks(code_corpus(spark, sf_dir), ["file_id"], "code", "lang")
    return out.select("file_id", "chunk_no", "start_line", "end_line", "n_lines", "kind", "hash")


# ------------------------------------------------------------------ C1c

@query("drop_trivial_chunks", f"""WITH RECURSIVE {blocks_sql(CC + ", files AS (SELECT file_id, lang, code FROM cc)")},
{fallback_sql("srcs AS (SELECT 'code' AS src, file_id AS id, lang, code AS text FROM files WHERE file_id NOT IN (SELECT file_id FROM blk))")},
kl AS (SELECT file_id, chunk_no, start_line, kind, unnest(string_split(text, chr(10))) AS line,
              generate_subscripts(string_split(text, chr(10)), 1) AS i FROM blk WHERE kind = 'class_definition'),
kc AS (SELECT *, length(line) - length({pylstrip('line')}) AS ind FROM kl WHERE {pystrip('line')} <> ''),
ms AS (SELECT m.file_id, m.chunk_no, m.start_line, m.i, min(n.i) FILTER (WHERE n.i > m.i AND n.ind <= m.ind) AS next
       FROM kc m JOIN kc n USING (file_id, chunk_no) WHERE m.ind > 0 AND regexp_matches(m.line, '^\\s+(async\\s+)?def\\s') GROUP BY ALL),
methods AS (SELECT ms.file_id, ms.start_line + ms.i - 1 AS start_line, ms.start_line + max(p.i) - 1 AS end_line
            FROM ms JOIN kc p ON p.file_id = ms.file_id AND p.chunk_no = ms.chunk_no AND (next IS NULL OR p.i < next) GROUP BY ms.file_id, ms.start_line, ms.i),
pieces AS (
  SELECT file_id, start_line, end_line, kind, NULL AS parent_kind, text FROM blk
  UNION ALL SELECT id, start_line, end_line, NULL, NULL, text FROM fb
  UNION ALL SELECT file_id, start_line, end_line, 'function_definition', 'class_definition', NULL FROM methods
  UNION ALL
  SELECT file_id, start_line, end_line, 'variable_declarator', 'lexical_declaration',
         regexp_extract(text, '^(const|let)\\s+((?s:.*));\\s*$', 2)
  FROM blk WHERE kind = 'lexical_declaration')
SELECT file_id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, kind, parent_kind
FROM pieces
WHERE NOT coalesce((kind = 'variable_declarator' AND len({l1(pystrip('text'))}) < 2 AND length({pystrip('text')}) < 30), false)
  AND NOT (parent_kind IS NOT NULL AND end_line - start_line < 2)""", kind="R")
def q_drop_trivial_chunks(spark, sf_dir):
    """Every block, every method of its class and every declarator of its declaration, without the trivial ones."""
    return C.drop_trivial(B.pieces(B.block_chunks(code_corpus(spark, sf_dir), ["file_id"], "code", "lang"), ["file_id"])).select(
        "file_id", "start_line", "end_line", "kind", "parent_kind")


# ------------------------------------------------------------------ C1b

@query("drop_contained_ranges", """
WITH iv AS (SELECT user_id, event_id, ts AS s, ts + to_microseconds(CAST(floor(value * 3600000000) AS BIGINT)) AS e FROM events),
r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM iv)
SELECT user_id, event_id, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS start_ts, strftime(e, '%Y-%m-%d %H:%M:%S.%f') AS end_ts
FROM r WHERE pm IS NULL OR e > pm""")
def q_drop_contained_ranges(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.col("ts").alias("s"),
        F.timestamp_add("MICROSECOND", F.floor(F.col("value") * 3600000000).cast("bigint"), F.col("ts")).alias("e"))
    # hour buckets: a burst of one user inside a day is still split over tasks
    kept = C.drop_contained(ev, ["user_id"], "s", "e", "event_id", F.date_trunc("HOUR", "s"))
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return kept.select("user_id", "event_id", F.date_format("s", fmt).alias("start_ts"), F.date_format("e", fmt).alias("end_ts"))


# ------------------------------------------------------------------ C1d

GAP_CHARS = 40


@query("merge_adjacent", f"""
WITH l AS (SELECT doc_id, {l1('text')} AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
g AS (SELECT *, length({pystrip('line')}) < {GAP_CHARS} AS gap FROM x),
s AS (SELECT *, CASE WHEN i = 1 OR NOT (lag(gap) OVER (PARTITION BY doc_id ORDER BY i) AND gap) THEN 1 ELSE 0 END AS st FROM g),
k AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY i) AS isl FROM s)
SELECT doc_id, CAST(min(i) AS INTEGER) AS start_line, CAST(max(i) AS INTEGER) AS end_line, CAST(count(*) AS INTEGER) AS n_pieces,
       bool_and(gap) AS is_gap, sha256(string_agg(line, chr(10) ORDER BY i)) AS hash
FROM k GROUP BY doc_id, isl""")
def q_merge_adjacent(spark, sf_dir):
    d = C.with_merged_gaps(table(spark, sf_dir, "documents"), lines_l1("text"),
                           lambda l: F.length(py_strip(l)) < GAP_CHARS)
    return (explode_rows(d, ["doc_id"], "merged", "m")
            .select("doc_id", "m.start_line", "m.end_line", "m.n_pieces", "m.is_gap", F.sha2("m.text", 256).alias("hash")))


# ------------------------------------------------------------------ C5

PACK_ORACLE = f"""WITH RECURSIVE {fallback_sql("srcs AS (SELECT 'doc' AS src, doc_id AS id, lang, text FROM documents)")},
pieces AS (SELECT 'conv' AS src, conv_id AS id, CAST(turn AS BIGINT) AS ord, text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS o FROM conversations
           UNION ALL SELECT 'doc', id, CAST(chunk_no AS BIGINT), text, chunk_no + 1 FROM fb),
r AS (SELECT src, id, o, CAST(length(text) AS BIGINT) AS len, 0 AS b FROM pieces WHERE o = 1
      UNION ALL
      SELECT p.src, p.id, p.o,
             CASE WHEN r.len + 9 + length(p.text) > 4000 THEN length(p.text)
                  ELSE r.len + CASE WHEN r.len > 0 THEN 9 ELSE 0 END + length(p.text) END,
             CASE WHEN r.len + 9 + length(p.text) > 4000 THEN r.b + 1 ELSE r.b END
      FROM r JOIN pieces p ON p.src = r.src AND p.id = r.id AND p.o = r.o + 1)
SELECT r.src, r.id, CAST(r.b AS INTEGER) AS batch_no, min(p.ord) AS first_ord, max(p.ord) AS last_ord,
       CAST(count(*) AS INTEGER) AS n_pieces, CAST(length(string_agg(p.text, {DELIM_SQL} ORDER BY p.o)) AS INTEGER) AS n_chars,
       sha256(string_agg(p.text, {DELIM_SQL} ORDER BY p.o)) AS hash
FROM r JOIN pieces p ON p.src = r.src AND p.id = r.id AND p.o = r.o GROUP BY r.src, r.id, r.b"""


@query("pack_batches", PACK_ORACLE, kind="R")
def q_pack_batches(spark, sf_dir):
    # turns of a conversation: packed without collecting a conversation
    conv = (C.pack_groups(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"),
                          ["conv_id"], "turn", "text")
            .select(F.lit("conv").alias("src"), F.col("conv_id").alias("id"), "batch_no", "first_ord", "last_ord",
                    "n_pieces", F.length("text").cast("int").alias("n_chars"), F.sha2("text", 256).alias("hash")))
    # chunks of one document: one row, packed in-row
    docs = C.with_fallback_chunks(table(spark, sf_dir, "documents"), "text", C.threshold_for("lang"))
    dp = docs.select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"),
                     F.transform("chunks", lambda c: F.struct(c["chunk_no"].cast("bigint").alias("ord"),
                                                            c["text"].alias("text"))).alias("pieces"))
    dpk = (explode_rows(C.with_packed(dp, "pieces"), ["src", "id"], "batches", "b")
           .select("src", "id", "b.batch_no", "b.first_ord", "b.last_ord", "b.n_pieces",
                   F.length("b.text").cast("int").alias("n_chars"), F.sha2("b.text", 256).alias("hash")))
    return conv.unionByName(dpk)


@query("pack_functions", PACK_ORACLE[:PACK_ORACLE.index("SELECT r.src")].replace("AS ord, text", "AS ord, 0 AS start_line, 0 AS end_line, text", 1)
       .replace("AS BIGINT), text, chunk_no + 1", "AS BIGINT), start_line, end_line, text, chunk_no + 1") + """
SELECT r.id AS doc_id, CAST(r.b AS INTEGER) AS batch_no, string_agg(p.start_line || '-' || p.end_line, ',' ORDER BY p.o) AS functions
FROM r JOIN pieces p ON p.src = r.src AND p.id = r.id AND p.o = r.o WHERE r.src = 'doc' GROUP BY r.id, r.b""", kind="R")
def q_pack_functions(spark, sf_dir):
    """The line ranges of the chunks in each packed batch of a document."""
    docs = C.with_fallback_chunks(table(spark, sf_dir, "documents"), "text", C.threshold_for("lang"))
    pieces = docs.select("doc_id", F.transform("chunks", lambda c: F.struct(
        c["chunk_no"].cast("bigint").alias("ord"), c["text"].alias("text"), c["start_line"].alias("start_line"), c["end_line"].alias("end_line"))).alias("pieces"))
    packed = explode_rows(C.with_packed(pieces, "pieces", carry=("start_line", "end_line")), ["doc_id"], "batches", "b")
    ranges = F.transform("b.functions", lambda f: F.concat_ws("-", f["start_line"], f["end_line"]))
    return packed.select("doc_id", "b.batch_no", F.array_join(ranges, ",").alias("functions"))


# ------------------------------------------------------------------ C4

def _cut_sql(source: str, sep: str) -> str:
    """Spans (id, path, s) of ``source``, those of more than 512 characters cut at ``sep``, which stays in front of what follows."""
    return f"""SELECT id, path, s FROM {source} WHERE length(s) <= 512
  UNION ALL SELECT id, list_append(path, i), CASE WHEN i = 1 THEN s[1] || part ELSE {sep} || part END
  FROM (SELECT id, path, s, unnest(string_split(s[2:], {sep})) AS part, generate_subscripts(string_split(s[2:], {sep}), 1) AS i
        FROM {source} WHERE length(s) > 512)"""


# Every span that may begin a piece knows the span that ends this piece and the one the next piece begins with.
RECURSIVE_ORACLE = f"""WITH RECURSIVE s0 AS (SELECT doc_id AS id, CAST([] AS BIGINT[]) AS path, text AS s FROM documents WHERE text <> ''),
s1 AS ({_cut_sql('s0', 'chr(10) || chr(10)')}), s2 AS ({_cut_sql('s1', 'chr(10)')}), s3 AS ({_cut_sql('s2', "';'")}),
sp AS (SELECT id, coalesce(sum(length(s)) OVER (PARTITION BY id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o,
              length(s) AS len FROM s3),
back AS (SELECT c.id, c.o, min(b.o) AS again FROM sp c JOIN sp b ON b.id = c.id AND b.o <= c.o AND (b.o = c.o OR b.o >= c.o - least(64, 512 - c.len)) GROUP BY ALL),
stop AS (SELECT a.id, a.o AS start, min(c.o) AS o FROM sp a JOIN sp c ON c.id = a.id AND c.o > a.o AND c.o + c.len - a.o > 512 GROUP BY ALL),
nx AS (SELECT stop.id, start, stop.o AS stop, again FROM stop JOIN back ON back.id = stop.id AND back.o = stop.o),
r AS (SELECT id, 0 AS k, CAST(0 AS HUGEINT) AS start FROM s0
      UNION ALL SELECT r.id, r.k + 1, nx.again FROM r JOIN nx ON nx.id = r.id AND nx.start = r.start),
p AS (SELECT r.id, r.k, r.start, coalesce(nx.stop, length(s0.s)) AS stop, s0.s FROM r JOIN s0 ON s0.id = r.id LEFT JOIN nx ON nx.id = r.id AND nx.start = r.start)
SELECT id AS doc_id, CAST(k AS INTEGER) AS piece_no, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end",
       CAST(stop - start AS INTEGER) AS n_chars, sha256(substring(s, CAST(start AS BIGINT) + 1, CAST(stop - start AS BIGINT))) AS hash FROM p"""


@query("chunk_recursive", RECURSIVE_ORACLE, kind="R")
def q_chunk_recursive(spark, sf_dir):
    d = with_recursive_pieces(table(spark, sf_dir, "documents"), "text")
    return (explode_rows(d, ["doc_id"], "pieces", "p")
            .select("doc_id", "p.piece_no", "p.start", "p.end", F.length("p.text").alias("n_chars"),
                    F.sha2("p.text", 256).alias("hash")))
