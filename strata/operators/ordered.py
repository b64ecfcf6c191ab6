"""Ordered scans over groups that may be hot (one key holding a third of the
rows), without a window over a whole group.

Every helper splits a group's order into blocks: windows run per
(group, block); a small per-(group, block) table carries what earlier (or
later) blocks contribute. The block tables have one row per block, so their
own windows stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocked_running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, block: Column,
                        out: str) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order`` within each group.
    ``block`` must be monotone in ``order``."""
    d = df.withColumn("_rsb", block).withColumn("_val", value)
    per_b = d.groupBy(*keys, "_rsb").agg(F.sum("_val").alias("_bsum"))
    wb = Window.partitionBy(*keys).orderBy("_rsb").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_b.select(*keys, "_rsb", F.coalesce(F.sum("_bsum").over(wb), F.lit(0)).alias("_carry"))
    wl = Window.partitionBy(*keys, "_rsb").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumn("_loc", F.sum("_val").over(wl))
    return (local.join(carry, [*keys, "_rsb"], "left")
            .withColumn(out, F.col("_carry") + F.col("_loc")).drop("_rsb", "_val", "_carry", "_loc"))


def asof_first(events: DataFrame, probes: DataFrame, keys: list[str], width) -> DataFrame:
    """For each probe (keys, t, src): the first event (keys, t, id) of its
    group with event.t >= probe.t (ties by id). Returns (src, nxt) with nxt
    null when there is none. ``width`` buckets the t axis (same units)."""
    ev = events.select(*keys, "t", F.lit(1).alias("_typ"), F.col("id").alias("_eid"),
                       F.lit(None).cast("long").alias("_src"))
    pr = probes.select(*keys, "t", F.lit(0).alias("_typ"), F.lit(None).cast("long").alias("_eid"),
                       F.col("src").alias("_src"))
    u = ev.unionByName(pr).withColumn("_b", F.floor(F.col("t") / F.lit(width)))
    cand = F.when(F.col("_typ") == 1, F.struct(F.col("t").alias("t"), F.col("_eid").alias("id")))
    w = (Window.partitionBy(*keys, "_b").orderBy("t", "_typ", "_eid")
         .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    local = u.withColumn("_hit", F.first(cand, ignorenulls=True).over(w)).filter(F.col("_typ") == 0)
    per_b = u.groupBy(*keys, "_b").agg(F.min(cand).alias("_bfirst"))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    later = per_b.select(*keys, "_b", F.first("_bfirst", ignorenulls=True).over(wb).alias("_later"))
    j = local.join(later, [*keys, "_b"], "left")
    return j.select(F.col("_src").alias("src"), F.coalesce(F.col("_hit"), F.col("_later"))["id"].alias("nxt"))


def asof_last(events: DataFrame, probes: DataFrame, keys: list[str], block: str) -> DataFrame:
    """For each probe (keys, o, src, <block>): the last marked event (keys,
    o, id, <block>) of its group with event.o <= probe.o. Returns (src, prev)."""
    ev = events.select(*keys, "o", block, F.lit(0).alias("_typ"), F.col("id").alias("_eid"),
                       F.lit(None).cast("long").alias("_src"))
    pr = probes.select(*keys, "o", block, F.lit(1).alias("_typ"), F.lit(None).cast("long").alias("_eid"),
                       F.col("src").alias("_src"))
    u = ev.unionByName(pr)
    w = (Window.partitionBy(*keys, block).orderBy("o", "_typ")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = u.withColumn("_hit", F.last("_eid", ignorenulls=True).over(w)).filter(F.col("_typ") == 1)
    per_b = u.groupBy(*keys, block).agg(F.max_by("_eid", F.when(F.col("_typ") == 0, F.col("o"))).alias("_blast"))
    wb = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    earlier = per_b.select(*keys, block, F.last("_blast", ignorenulls=True).over(wb).alias("_earlier"))
    j = local.join(earlier, [*keys, block], "left")
    return j.select(F.col("_src").alias("src"), F.coalesce(F.col("_hit"), F.col("_earlier")).alias("prev"))


def follow_chains(jump: DataFrame, roots: DataFrame, rounds: int, checkpoint) -> DataFrame:
    """Nodes reachable from ``roots`` (id) along ``jump`` (id -> nxt) within
    2**rounds - 1 steps, by pointer doubling: T := T u J_i(T), J_{i+1} = J_i o J_i.
    Each round is two equi-joins on the id; ``checkpoint`` materialises."""
    j = checkpoint(jump.filter(F.col("nxt").isNotNull()))
    kept = checkpoint(roots.select("id").distinct())
    for i in range(rounds):
        step = kept.join(j, "id", "inner").select(F.col("nxt").alias("id"))
        kept = checkpoint(kept.unionByName(step).distinct())
        if i + 1 < rounds:
            j2 = j.alias("a").join(j.alias("b"), F.col("a.nxt") == F.col("b.id"), "inner")
            j = checkpoint(j2.select(F.col("a.id").alias("id"), F.col("b.nxt").alias("nxt")))
    return kept
