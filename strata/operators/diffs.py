"""Diffs and snapshot comparison.

* Near-copy pairs: documents are first collapsed by exact content hash
  (copies are one representative; only hashes and small token arrays are
  shuffled, never texts), then pairs of representatives whose
  distinct line hash sets have Jaccard >= threshold are found with
  *prefix filtering* (exact): tokens are ordered by (document frequency,
  hash); two sets that reach the threshold must share a token inside both
  prefixes, so only prefix tokens are joined, under a length and a position
  filter; a frequent token's texts are dealt to parts. Candidates are verified
  with the exact intersection size. No all-pairs join.
* D1b multiset line statistics: per-document line counts, joined per pair
  with a full outer join.
* D3 snapshot comparison: counts per (key, row, item) of both snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import lines_l1, py_strip


#: Texts of one part of a frequent token.
PART_TEXTS = 2_000


def line_token_array(text, min_len: int = 1) -> Column:
    """Distinct sha256 hashes of the stripped lines of at least ``min_len`` characters (in-row); 1: all that aren't blank."""
    return F.array_distinct(F.transform(F.filter(F.transform(lines_l1(text), lambda l: py_strip(l)),
                                                 lambda l: F.length(l) >= min_len),
                                        lambda l: F.sha2(l, 256)))


def near_copy_pairs(docs: DataFrame, id_col: str, text: str, threshold_num: int = 1, threshold_den: int = 2,
                    min_len: int = 1) -> DataFrame:
    """Pairs (id_a < id_b) of distinct texts with Jaccard(lines) >=
    num/den, on one representative (smallest id) per exact text.

    Only (hash, id, token array) rows are shuffled, never the texts.
    Returns (id_a, id_b, n_a, n_b, n_common)."""
    d = docs.select(F.col(id_col).alias("id"), F.sha2(F.col(text), 256).alias("_h"),
                    line_token_array(F.col(text), min_len).alias("s"))
    reps = (d.groupBy("_h").agg(F.min_by(F.struct("id", "s"), F.col("id")).alias("_r"))
            .select("_r.id", "_r.s"))
    toks = reps.select("id", F.explode("s").alias("tok"), F.size("s").alias("_n"))
    df_tok = toks.groupBy("tok").agg(F.count(F.lit(1)).alias("_df"))
    # global token order: rare first; rank inside each text by that order
    w = Window.partitionBy("id").orderBy("_df", "tok")
    ranked = toks.join(df_tok, "tok").withColumn("_pos", F.row_number().over(w))
    # prefix length for Jaccard >= t: n - ceil(t * n) + 1
    need = F.ceil(F.col("_n") * threshold_num / threshold_den)
    prefix = ranked.filter(F.col("_pos") <= F.col("_n") - need + 1)
    # the texts of a frequent token are dealt to parts; each meets all texts of the token, part by part
    parts = F.ceil(F.col("_df") / PART_TEXTS).cast("int")
    a = prefix.select("id", "tok", "_n", "_pos", F.pmod(F.xxhash64("id"), parts).cast("int").alias("_part")).alias("a")
    b = prefix.select("id", "tok", "_n", "_pos", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part")).alias("b")
    # position filter: what two texts share is at most what lies up to the shared token in both, and what lies behind it in both
    most = F.least("a._pos", "b._pos") + F.least(F.col("a._n") - F.col("a._pos"), F.col("b._n") - F.col("b._pos"))
    cand = (a.join(b, (F.col("a.tok") == F.col("b.tok")) & (F.col("a._part") == F.col("b._part")) & (F.col("a.id") < F.col("b.id"))
                   # length filter: |small| >= t * |large|
                   & (F.least("a._n", "b._n") * threshold_den >= F.greatest("a._n", "b._n") * threshold_num)
                   & (most * (threshold_num + threshold_den) >= (F.col("a._n") + F.col("b._n")) * threshold_num))
            .select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct())
    sa, sb = reps.alias("sa"), reps.alias("sb")
    v = (cand.join(sa, F.col("id_a") == F.col("sa.id")).join(sb, F.col("id_b") == F.col("sb.id"))
         .select("id_a", "id_b", F.size("sa.s").alias("n_a"), F.size("sb.s").alias("n_b"),
                 F.size(F.array_intersect("sa.s", "sb.s")).alias("n_common")))
    inter, union = F.col("n_common"), F.col("n_a") + F.col("n_b") - F.col("n_common")
    return v.filter(inter * threshold_den >= union * threshold_num)


def copy_members(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, rep_id) for every row: the representative (smallest id of equal texts) that stands for it in ``near_copy_pairs``.

    Only hashes and ids are shuffled; null texts are one class."""
    d = docs.select(id_col, F.sha2(F.col(text), 256).alias("_h"))
    reps = d.groupBy("_h").agg(F.min(id_col).alias("rep_id")).withColumnRenamed("_h", "_rh")
    return d.join(reps, F.col("_h").eqNullSafe(F.col("_rh"))).select(id_col, "rep_id")


def line_counts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, line, c): multiplicity of each L1 line of a text."""
    return (df.select(id_col, F.explode(lines_l1(text)).alias("line"))
            .groupBy(id_col, "line").agg(F.count(F.lit(1)).alias("c")))


def diff_stats(pairs: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Lines kept / removed / added between the two texts of each pair,
    with multiplicity (an occurrence matches at most one occurrence).
    Lines are exploded only for texts that are in some pair. The pair table
    (small: one row per output row) is written once to the shared checkpoint
    folder because it feeds three joins."""
    from ..session import checkpoint_dir
    checkpoint_dir(pairs.sparkSession)
    p = pairs.select("id_a", "id_b").checkpoint(eager=True)
    ids = p.select(F.col("id_a").alias(id_col)).union(p.select(F.col("id_b").alias(id_col))).distinct()
    lc = line_counts(docs.select(id_col, text).join(ids, id_col, "left_semi"), id_col, text)
    pa = p.join(lc.withColumnRenamed(id_col, "id_a").withColumnRenamed("c", "ca"), "id_a")
    pb = p.join(lc.withColumnRenamed(id_col, "id_b").withColumnRenamed("c", "cb"), "id_b")
    j = pa.join(pb, ["id_a", "id_b", "line"], "full_outer")
    ca, cb = F.coalesce(F.col("ca"), F.lit(0)), F.coalesce(F.col("cb"), F.lit(0))
    kept = F.least(ca, cb)
    return j.groupBy("id_a", "id_b").agg(F.sum(kept).cast("bigint").alias("n_kept"),
                                         F.sum(ca - kept).cast("bigint").alias("n_removed"),
                                         F.sum(cb - kept).cast("bigint").alias("n_added"))


# ------------------------------------------------------------------ D3 snapshot comparison

def compare_snapshots(old_items: DataFrame, new_items: DataFrame, keys: list[str], row: str, item: str,
                      include_removed: bool = False) -> DataFrame:
    """D3 over item rows ``(keys..., row, item)``: a snapshot row is a
    (key, row) group with a list of items. For old duplicates of a key the
    last row wins; each new row reports the items it added (not in the old
    list) and the old items it lost (not in its own list). The counts keep
    duplicates, the texts name each item once.

    Both snapshots are counted per (key, row, item) in one aggregation. An item
    of a new row then meets at most one count of the old list, and what a row
    lost is the old list's total less what it shares, so no join multiplies old
    items by new rows. Null items match nothing; a row with a null key has no old list."""
    tagged = (old_items.select(*keys, row, item, F.lit(True).alias("_is_old"))
              .unionByName(new_items.select(*keys, row, item, F.lit(False).alias("_is_old"))))
    counts = tagged.groupBy(*keys, row, item, "_is_old").agg(F.count(F.lit(1)).alias("_n"))
    old, new = counts.filter("_is_old").drop("_is_old"), counts.filter("not _is_old").drop("_is_old")
    last = old.groupBy(*keys).agg(F.max(row).alias("_last"))
    old = (old.join(last, keys).filter(F.col(row) == F.col("_last")).select(*keys, item, F.col("_n").alias("_old_n")))
    lists = old.groupBy(*keys).agg(F.sum("_old_n").alias("_old_total"), F.sort_array(F.collect_set(item)).alias("_old_names"))
    is_new = F.col("_old_n").isNull()
    rows = (new.join(old, [*keys, item], "left").groupBy(*keys, row)
            .agg(F.sum(F.when(is_new, F.col("_n")).otherwise(0)).alias("n_added"),
                 F.array_join(F.sort_array(F.collect_set(F.when(is_new, F.col(item)))), ",").alias("added"),
                 F.sum(F.coalesce("_old_n", F.lit(0))).alias("_shared"), F.collect_set(item).alias("_names")))
    lost = F.coalesce(F.array_except("_old_names", "_names"), F.array().cast("array<string>"))
    out = (rows.join(lists, keys, "left")
           .select(*keys, row, F.col("n_added").cast("bigint").alias("n_added"), "added",
                   (F.coalesce("_old_total", F.lit(0)) - F.col("_shared")).cast("bigint").alias("n_removed"),
                   F.array_join(lost, ",").alias("removed")))
    if include_removed:
        gone = lists.join(rows.select(*keys).distinct(), keys, "left_anti")
        out = out.unionByName(gone.select(*keys, F.lit(None).cast(new_items.schema[row].dataType).alias(row),
                                          F.lit(0).cast("bigint").alias("n_added"), F.lit("").alias("added"),
                                          F.col("_old_total").cast("bigint").alias("n_removed"),
                                          F.array_join("_old_names", ",").alias("removed")))
    return out


__all__ = ["near_copy_pairs", "copy_members", "diff_stats", "compare_snapshots"]
