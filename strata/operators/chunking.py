"""Chunkers (C1-C6) and interval helpers (C1b-C1d).

Physical layout:

* A file/document is one row. C2 (fallback fold), C3 (fixed windows) and
  C1d (gap merge) run *inside the row* with higher-order functions: no line
  explode, no shuffle, codegen-friendly.
* C1 (definition blocks) is in ``blocks``; it works inside the row, too.
* C1b (contained ranges) runs over a *group* (e.g. a user) that may be
  hot; it uses a two-level running max: per (group, time bucket) partitions
  plus a carried-in maximum from the earlier buckets of the group.
* C5 (packing) folds the ordered pieces of one file/conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import (BATCH_DELIMITER, BATCH_MAX_CHARS, DEFAULT_THRESHOLD,
                              FALLBACK_THRESHOLDS, RAG_LINES_PER_CHUNK)
from ..functions.lines import explode_rows, indent_of, lines_l1, lines_l2, py_strip


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def threshold_for(lang) -> Column:
    m = F.create_map(*[F.lit(x) for kv in FALLBACK_THRESHOLDS.items() for x in kv])
    return F.coalesce(F.try_element_at(m, _c(lang)), F.lit(DEFAULT_THRESHOLD))


# ------------------------------------------------------------------ C2 fallback fold

CHUNK_TYPE = ("array<struct<chunk_no:int,start_line:int,end_line:int,start_ord:int,end_ord:int,"
              "n_lines:int,kind:string,text:string>>")


def with_fallback_chunks(df: DataFrame, text: str, threshold: Column, out: str = "chunks") -> DataFrame:
    """Skip blank lines; close the buffer after a line when it holds
    ``threshold`` lines or when the line is indented less than the previous
    line *of the same buffer*. Adds ``out`` = array<struct> (CHUNK_TYPE).

    The fold state is (lines in buffer, previous indent, flush ordinals); it
    is a sequential rule (a buffer reset changes the next test), so it is an
    ``aggregate`` over the row's non-blank lines, not a ``lag``. Each
    intermediate array is its own column so it is computed once per row.
    """
    d = df.withColumn("_t", threshold).withColumn("_nb", F.filter(
        F.transform(lines_l1(text), lambda l, i: F.struct((i + 1).alias("phys"), l.alias("line"),
                                                           indent_of(l).alias("indent"))),
        lambda x: py_strip(x["line"]) != ""))
    d = d.withColumn("_nb", F.transform("_nb", lambda x, i: F.struct(
        x["phys"].alias("phys"), x["line"].alias("line"), x["indent"].alias("indent"), i.alias("o"))))
    init = F.struct(F.lit(0).alias("n"), F.lit(0).alias("prev"), F.array().cast("array<int>").alias("fl"))

    def step(acc, x):
        n1 = acc["n"] + 1
        flush = (n1 >= F.col("_t")) | ((n1 >= 2) & (x["indent"] < acc["prev"]))
        return F.struct(F.when(flush, F.lit(0)).otherwise(n1).alias("n"), x["indent"].alias("prev"),
                        F.when(flush, F.concat(acc["fl"], F.array(x["o"]))).otherwise(acc["fl"]).alias("fl"))

    d = d.withColumn("_fl", F.aggregate("_nb", init, step, lambda acc: acc["fl"]))
    m = F.size("_nb")
    fl = F.col("_fl")
    d = d.withColumn("_ends", F.when((m > 0) & ((F.size(fl) == 0) | (F.element_at(fl, -1) != m - 1)),
                                     F.concat(fl, F.array(m - 1))).otherwise(fl))
    return d.withColumn(out, _chunks_from_ends(F.col("_nb"), F.col("_ends"))).drop("_t", "_nb", "_fl", "_ends")


def _chunks_from_ends(nb: Column, ends: Column, kind: Column | None = None) -> Column:
    def mk(e, k):
        s = F.when(k == 0, F.lit(0)).otherwise(F.element_at(ends, F.greatest(k, F.lit(1))) + 1)
        first = F.element_at(nb, s + 1)
        last = F.element_at(nb, e + 1)
        body = F.array_join(F.transform(F.slice(nb, s + 1, e - s + 1), lambda x: x["line"]), "\n")
        return F.struct(k.alias("chunk_no"), first["phys"].alias("start_line"), last["phys"].alias("end_line"),
                        (s + 1).alias("start_ord"), (e + 1).alias("end_ord"), (e - s + 1).alias("n_lines"),
                        (kind if kind is not None else F.lit(None).cast("string")).alias("kind"),
                        body.alias("text"))
    return F.transform(ends, mk)


def explode_chunks(df: DataFrame, keys: list[str], chunks: str = "chunks") -> DataFrame:
    return (explode_rows(df, keys, chunks, "c")
            .select(*keys, "c.chunk_no", "c.start_line", "c.end_line", "c.start_ord", "c.end_ord",
                    "c.n_lines", "c.kind", F.sha2(F.col("c.text"), 256).alias("hash"), F.col("c.text").alias("text")))


def chunk_fallback(df: DataFrame, keys: list[str], text: str, lang: str) -> DataFrame:
    return explode_chunks(with_fallback_chunks(df, text, threshold_for(lang)), keys)


# ------------------------------------------------------------------ C3 fixed windows

def with_fixed_line_chunks(df: DataFrame, text: str, size: int = RAG_LINES_PER_CHUNK,
                           out: str = "chunks") -> DataFrame:
    """Windows of ``size`` physical lines under the readlines model
    (each line keeps its newline). In-row: ``sequence`` of window starts
    and ``slice``; no explode before the windows exist."""
    d = df.withColumn("_l2", lines_l2(text))
    l2 = F.col("_l2")
    n2 = F.size(l2)
    d = d.withColumn("_np", F.when(F.element_at(l2, -1) == "", n2 - 1).otherwise(n2))
    n_phys = F.col("_np")
    n_chunks = F.floor((n_phys + (size - 1)) / size).cast("int")

    def mk(k):
        start = k * size
        cnt = F.least(F.lit(size), n_phys - start)
        body = F.array_join(F.slice(l2, start + 1, cnt), "\n")
        nl = F.when(start + cnt < n2, F.lit("\n")).otherwise(F.lit(""))
        return F.struct(k.alias("chunk_no"), (start + 1).alias("start_line"), (start + cnt).alias("end_line"),
                        F.concat(body, nl).alias("text"))
    seq = F.when(n_chunks > 0, F.sequence(F.lit(0), n_chunks - 1)).otherwise(F.array().cast("array<int>"))
    return d.withColumn(out, F.transform(seq, mk)).drop("_l2", "_np")


# ------------------------------------------------------------------ C1b contained ranges

def drop_contained(df: DataFrame, keys: list[str], start: str, end: str, tie: str, bucket: Column) -> DataFrame:
    """In (start asc, end desc, tie) order, keep an interval when its
    end passes every earlier end of its group (i.e. it is not contained in
    an earlier interval).

    Two-level running max so that one hot group is spread over tasks:
    ``bucket`` must be monotone in ``start`` (e.g. the day of the start);
    rows are windowed per (group, bucket) and get the max end of all earlier
    buckets of the group from a small per-(group, bucket) table.
    """
    d = df.withColumn("_b", bucket)
    per_b = d.groupBy(*keys, "_b").agg(F.max(end).alias("_bmax"))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_b.select(*keys, "_b", F.max("_bmax").over(wb).alias("_carry"))
    wr = (Window.partitionBy(*keys, "_b").orderBy(F.col(start), F.col(end).desc(), F.col(tie))
          .rowsBetween(Window.unboundedPreceding, -1))
    local = d.withColumn("_prev", F.max(end).over(wr))
    j = local.join(carry, [*keys, "_b"], "left")
    prev = F.greatest(F.col("_prev"), F.col("_carry"))
    return j.filter(prev.isNull() | (F.col(end) > prev)).drop("_b", "_prev", "_carry")


# ------------------------------------------------------------------ C1c trivial pieces

def drop_trivial(df: DataFrame, kind: str = "kind", parent_kind: str = "parent_kind", text: str = "text",
                 start_line: str = "start_line", end_line: str = "end_line") -> DataFrame:
    """Drop single-line declarators under 30 characters and nested
    pieces spanning fewer than two line steps."""
    t = py_strip(F.col(text))
    small_decl = (F.col(kind).eqNullSafe("variable_declarator") & (F.size(lines_l1(t)) < 2) & (F.length(t) < 30))
    nested_small = F.col(parent_kind).isNotNull() & ((F.col(end_line) - F.col(start_line)) < 2)
    return df.filter(~(small_decl | nested_small))


# ------------------------------------------------------------------ C1d merge adjacent gaps

def with_merged_gaps(df: DataFrame, lines: Column, is_gap, out: str = "merged") -> DataFrame:
    """C1d over one row: pieces are the row's lines (one piece per line,
    start = end = line number); directly adjacent gap pieces merge into one
    (text joined with '\\n'); non-gap pieces stay alone.
    ``is_gap`` is a function line -> boolean Column."""
    d = df.withColumn("_ls", lines)
    d = d.withColumn("_gf", F.transform("_ls", lambda l: is_gap(l)))
    flags = F.col("_gf")
    n = F.size("_ls")
    d = d.withColumn("_st", F.filter(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        lambda i: (i < n) & ((i == 0) | ~(F.element_at(flags, F.greatest(i, F.lit(1))) & F.element_at(flags, i + 1)))))
    starts = F.col("_st")

    def mk(s, k):
        nxt = F.when(k + 1 < F.size(starts), F.element_at(starts, k + 2)).otherwise(n)
        return F.struct((s + 1).alias("start_line"), nxt.alias("end_line"), (nxt - s).alias("n_pieces"),
                        F.element_at(flags, s + 1).alias("is_gap"),
                        F.array_join(F.slice(F.col("_ls"), s + 1, nxt - s), "\n").alias("text"))
    return d.withColumn(out, F.transform(starts, mk)).drop("_ls", "_gf", "_st")


# ------------------------------------------------------------------ C5 greedy packing

def with_packed(df: DataFrame, pieces: str, max_chars: int = BATCH_MAX_CHARS,
                delimiter: str = BATCH_DELIMITER, out: str = "batches", carry: tuple[str, ...] = ()) -> DataFrame:
    """C5 over one ordered array column of struct<ord, text>: next-fit packing.

    A piece closes the open batch when ``len(batch) + len(delimiter) +
    len(piece) > max_chars`` (the delimiter is counted even for the first
    piece of a batch); a batch is never closed before it has a piece, so no
    empty batch is produced and an oversize piece stands alone.
    Adds array<struct<batch_no, first_ord, last_ord, n_pieces, text>>; with ``carry``
    (fields of the pieces, e.g. their line ranges) also ``functions``, an array of
    these fields of the batch's pieces.
    """
    dl = len(delimiter)
    init = F.struct(F.lit(0).cast("bigint").alias("len"), F.lit(0).alias("n"),
                    F.array().cast("array<int>").alias("starts"))
    indexed = F.transform(pieces, lambda p, i: F.struct(i.alias("i"), F.length(p["text"]).cast("bigint").alias("l")))

    def step(acc, x):
        close = (acc["n"] > 0) & (acc["len"] + dl + x["l"] > max_chars)
        new_len = F.when(close, x["l"]).otherwise(acc["len"] + F.when(acc["len"] > 0, F.lit(dl)).otherwise(F.lit(0)) + x["l"])
        return F.struct(new_len.alias("len"), F.when(close, F.lit(1)).otherwise(acc["n"] + 1).alias("n"),
                        F.when(close | (x["i"] == 0), F.concat(acc["starts"], F.array(x["i"]))).otherwise(acc["starts"]).alias("starts"))

    d = df.withColumn("_bs", F.aggregate(indexed, init, step, lambda a: a["starts"]))
    starts = F.col("_bs")
    n = F.size(pieces)

    def mk(s, k):
        nxt = F.when(k + 1 < F.size(starts), F.element_at(starts, k + 2)).otherwise(n)
        part = F.slice(pieces, s + 1, nxt - s)
        texts = F.transform(part, lambda p: p["text"])
        # the delimiter goes between pieces, except right after an empty batch text
        body = F.aggregate(texts, F.lit(""), lambda acc, t: F.when(acc == "", t).otherwise(F.concat(acc, F.lit(delimiter), t)))
        return F.struct(k.alias("batch_no"), F.element_at(part, 1)["ord"].alias("first_ord"),
                        F.element_at(part, -1)["ord"].alias("last_ord"), (nxt - s).alias("n_pieces"), body.alias("text"),
                        *([F.transform(part, lambda p: F.struct(*[p[c].alias(c) for c in carry])).alias("functions")] if carry else []))
    return d.withColumn(out, F.transform(starts, mk)).drop("_bs")


def _ckpt(df: DataFrame) -> DataFrame:
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


GROUP_FOLD_BOUND = 10_000


def pack_groups(pieces: DataFrame, keys: list[str], ord_col: str, text: str, max_chars: int = BATCH_MAX_CHARS,
                delimiter: str = BATCH_DELIMITER, bound: int = GROUP_FOLD_BOUND) -> DataFrame:
    """C5 over groups of rows (e.g. the turns of a conversation). Groups of
    at most ``bound`` rows are folded in one row each (``with_packed``,
    bounded memory); larger groups take the exact parallel path
    (``pack_groups_parallel``), which never collects a group. The parallel
    path only runs when some group is larger than the bound."""
    counts = pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    largest = counts.agg(F.max("_cnt")).first()[0] or 0
    sized = pieces.join(counts, keys)
    small = (sized.filter(F.col("_cnt") <= bound).groupBy(*keys)
             .agg(F.array_sort(F.collect_list(F.struct(F.col(ord_col).cast("bigint").alias("ord"),
                                                       F.col(text).alias("text")))).alias("_pieces")))
    out = (explode_rows(with_packed(small, "_pieces", max_chars, delimiter), keys, "batches", "b")
           .select(*keys, "b.batch_no", F.col("b.first_ord").alias("first_ord"), F.col("b.last_ord").alias("last_ord"),
                   "b.n_pieces", "b.text"))
    if largest > bound:
        big = sized.filter(F.col("_cnt") > bound).drop("_cnt")
        par = pack_groups_parallel(big, keys, ord_col, text, max_chars, delimiter)
        out = out.unionByName(par.select(*keys, "batch_no", F.col("first_ord").cast("bigint").alias("first_ord"),
                                         F.col("last_ord").cast("bigint").alias("last_ord"), "n_pieces", "text"))
    return out


def pack_groups_parallel(pieces: DataFrame, keys: list[str], ord_col: str, text: str,
                         max_chars: int = BATCH_MAX_CHARS, delimiter: str = BATCH_DELIMITER,
                         block: int = 1024) -> DataFrame:
    """C5 for large groups, with the same next-fit rule as ``with_packed``
    but without collecting a group.

    With Q = running sum of (len + |delimiter|) in order, a batch whose first
    non-empty piece is f closes before the first later piece i with
    Q[i] > Q[f] - len_f + max (a batch of only empty pieces closes before f
    when len_f alone is too long). So every piece j knows where a batch
    starting at j would end (``next``, an as-of lookup on Q); the real batch
    starts are the chain root -> next -> next ... of each group, followed by
    pointer doubling. All scans are blocked (see ``ordered``); ``ord_col``
    must be unique inside a group. Returns (keys, batch_no, first_ord,
    last_ord, n_pieces, text).
    """
    import math

    from .ordered import asof_first, asof_last, blocked_running_sum, follow_chains
    dl = len(delimiter)
    p = _ckpt(pieces.select(*keys, F.col(ord_col).alias("o"), F.col(text).alias("text"),
                            F.length(text).cast("long").alias("l"))
              .withColumn("id", F.monotonically_increasing_id()))
    p = p.withColumn("_blk", F.floor(F.col("o") / block))
    q = blocked_running_sum(p, keys, ["o"], F.col("l") + dl, F.col("_blk"), "Q")
    # f: first non-empty piece at or after each piece
    nonempty = q.filter(F.col("l") > 0).select(*keys, F.col("o").alias("t"), "id")
    f = asof_first(nonempty, q.select(*keys, F.col("o").alias("t"), F.col("id").alias("src")), keys, block)
    fq = q.select(F.col("id").alias("nxt"), F.col("Q").alias("fQ"), F.col("l").alias("fl"))
    pj = q.join(f.withColumnRenamed("src", "id"), "id", "left").join(fq, "nxt", "left").withColumnRenamed("nxt", "f")
    early = F.col("f").isNotNull() & (F.col("f") != F.col("id")) & (F.col("fl") > max_chars - dl)
    probes = (pj.filter(F.col("f").isNotNull() & ~early)
              .select(*keys, (F.greatest(F.col("fQ") - F.col("fl") + max_chars, F.col("fQ")) + 1).alias("t"),
                      F.col("id").alias("src")))
    later = asof_first(q.select(*keys, F.col("Q").alias("t"), "id"), probes, keys, max_chars + dl)
    jump = (pj.filter(early).select("id", F.col("f").alias("nxt"))
            .unionByName(later.select(F.col("src").alias("id"), "nxt")))
    roots = p.groupBy(*keys).agg(F.min(F.struct("o", "id")).alias("_r")).select(F.col("_r.id").alias("id"))
    largest = p.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    starts = follow_chains(jump, roots, max(1, math.ceil(math.log2(largest + 1))), _ckpt)
    st = p.join(starts, "id", "left_semi")
    st = blocked_running_sum(st, keys, ["o"], F.lit(1), F.col("_blk"), "_rank")
    owner = asof_last(st.select(*keys, "o", "id", "_blk"), p.select(*keys, "o", F.col("id").alias("src"), "_blk"),
                      keys, "_blk")
    assigned = (p.join(owner.withColumnRenamed("src", "id"), "id")
                .join(st.select(F.col("id").alias("prev"), (F.col("_rank") - 1).cast("int").alias("batch_no")), "prev"))
    stats = assigned.groupBy(*keys, "batch_no").agg(
        F.min("o").alias("first_ord"), F.max("o").alias("last_ord"), F.count(F.lit(1)).cast("int").alias("n_pieces"),
        F.min(F.when(F.col("l") > 0, F.col("o"))).alias("_first_ne"))
    # leading empty pieces add neither text nor a delimiter; leaving them out
    # bounds what is collected per batch (every other piece adds >= 9 chars)
    kept = (assigned.join(stats.select(*keys, "batch_no", "_first_ne"), [*keys, "batch_no"])
            .filter(F.col("o") >= F.col("_first_ne")))
    parts = kept.groupBy(*keys, "batch_no").agg(F.array_sort(F.collect_list(F.struct("o", "text"))).alias("_parts"))
    body = F.aggregate(F.transform("_parts", lambda x: x["text"]), F.lit(""),
                       lambda acc, t: F.when(acc == "", t).otherwise(F.concat(acc, F.lit(delimiter), t)))
    b = stats.join(parts, [*keys, "batch_no"], "left")
    return b.select(*keys, "batch_no", "first_ord", "last_ord", "n_pieces",
                    F.coalesce(body, F.lit("")).alias("text"))
