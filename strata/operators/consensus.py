"""Consensus of several verdicts per group.

Every vote is computed with *partial* aggregation only, so one group can
hold a third of all rows without landing in one task as a list:

* A1 share of true flags: ``avg`` (map-side combine).
* A2/A4 plurality with first-seen tie-break: ``count`` + ``min(ordinal)``
  per (group, value), then ``max_by`` per group.
* A3 upper median: counts per (group, risk value), running sum over the
  distinct values of the group (risks are validated scores in 0..10, so a
  group has a bounded number of distinct values), first value whose running
  count passes ``n div 2``.
* A5 confidence: top count per (group, value) with null and '' as values.

No ``collect_list`` of a group anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import AGREEMENT_THRESHOLD, NO_ANALYSES_ERROR, SEVERITY_BUCKETS


def severity_bucket(score) -> Column:
    """Inclusive bucket bounds; a value between two buckets gets null.
    The bound table is a fixed four-row dimension, so the range join is a
    CASE chain evaluated in the row (no join)."""
    s = F.col(score) if isinstance(score, str) else score
    expr = None
    for name, lo, hi in SEVERITY_BUCKETS:
        cond = (s >= F.lit(lo)) & (s <= F.lit(hi))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def _rank(first_col: str, names) -> Column:
    """Most votes first, then the earliest first vote (ordinal fields negated)."""
    return F.struct(F.col("_n"), *[-F.col(f"{first_col}.{f}") for f in names])


def _upper_median(votes: DataFrame, keys: list[str], risk: str, out: str) -> DataFrame:
    r = votes.select(*keys, F.coalesce(F.col(risk), F.lit(0.0)).alias("_r"))
    counts = r.groupBy(*keys, "_r").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wt = Window.partitionBy(*keys)
    cum = counts.withColumn("_cum", F.sum("_n").over(w)).withColumn("_tot", F.sum("_n").over(wt))
    hit = cum.filter(F.col("_cum") > F.floor(F.col("_tot") / 2))
    return hit.groupBy(*keys).agg(F.min("_r").alias(out))


def _same_group(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on the group; null keys are equal."""
    other = right.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    return left.join(other, cond, "left").drop(*[f"_g_{k}" for k in keys])


def consensus(votes: DataFrame, keys: list[str], ordinal: list[Column], flag: str = "flag", cwe: str = "cwe",
              risk: str = "risk", fix: str = "fix") -> DataFrame:
    """One consensus record per group.

    ``votes`` holds one verdict per row; ``ordinal`` (numeric columns,
    compared in order) gives the first-seen order inside a group (ties in
    the votes go to the earliest value).
    A missing flag counts as false, a missing risk as 0.0 and a missing fix
    as '' in the fix vote but as its own value in the confidence.

    Three pipelines over the votes, each one shuffle of pre-aggregated rows:
    (group, cwe) counts give the vote count, the flag share, the CWE
    plurality and the CWE top share; (group, fix) counts give the fix
    plurality (null and '' merged) and the fix top share; (group, risk)
    counts give the upper median.
    """
    ordv = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(ordinal)])
    names = [f"o{i}" for i in range(len(ordinal))]
    v = votes.select(*keys, ordv.alias("_ord"), flag, cwe, risk, fix)
    flag_int = F.coalesce(F.col(flag), F.lit(False)).cast("int")
    cc = v.groupBy(*keys, cwe).agg(F.count(F.lit(1)).alias("_n"), F.min("_ord").alias("_first"),
                                   F.sum(flag_int).alias("_pos"))
    real = F.col(cwe).isNotNull() & (F.col(cwe) != "")
    base = cc.groupBy(*keys).agg(
        F.sum("_n").cast("bigint").alias("n_votes"),
        (F.sum("_pos") / F.sum("_n") >= F.lit(AGREEMENT_THRESHOLD)).alias("is_vulnerability"),
        F.max_by(F.col(cwe), F.when(real, _rank("_first", names))).alias("cwe"),
        F.max("_n").alias("_top_cwe"))
    fc = v.groupBy(*keys, fix).agg(F.count(F.lit(1)).alias("_n"), F.min("_ord").alias("_first"))
    fn = (fc.groupBy(*keys, F.coalesce(F.col(fix), F.lit("")).alias("_f"))
          .agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"), F.max("_n").alias("_raw_top")))
    fx = fn.groupBy(*keys).agg(F.max_by(F.col("_f"), _rank("_first", names)).alias("fix_code"),
                               F.max("_raw_top").alias("_top_fix"))
    med = _upper_median(v, keys, risk, "risk_level")
    out = _same_group(_same_group(base, fx, keys), med, keys)
    conf = F.least(F.col("_top_cwe"), F.col("_top_fix")) / F.col("n_votes")
    return out.select(*keys, "n_votes", "is_vulnerability", "cwe", "risk_level", "fix_code",
                      F.round(conf, 6).alias("confidence"))


def consensus_missing(groups: DataFrame, votes: DataFrame, keys: list[str]) -> DataFrame:
    """A6 error branch: groups without any vote."""
    return groups.join(votes.select(*keys).distinct(), keys, "left_anti").select(
        *keys, F.lit(NO_ANALYSES_ERROR).alias("error"))
