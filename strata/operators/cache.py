"""Result cache as tables (H3-H7).

The file-per-key cache becomes relational operators over a cache table
``(key..., ts, value)`` and a request table; ``as_of`` is always an
argument (never ``now()``), so runs are reproducible.

* H4 upsert: last write per key wins, ``max_by`` with (ts, id) order;
  partial aggregation, so a hot key costs one combined row per partition.
* H3 lookup: requests joined with the valid entries (strict ``age < ttl``);
  hits via inner join, misses via ``left_anti``.
* H5 evict: newest N entries (``orderBy.limit`` -> TakeOrderedAndProject,
  a per-partition top-N then one merge; N is the cache size, the feature).
* H6 work once per distinct key: work runs on one representative per
  content hash, results join back on the hash (AQE splits a hot hash on
  the big side of that join).
* H7 TTL dedupe: see ``ttl_dedupe``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import CACHE_MAX_ENTRIES, CACHE_TTL_SECONDS


def cache_upsert(writes: DataFrame, keys: list[str], ts: str, value: str, tie: str) -> DataFrame:
    """H4: one entry per key, the last write by (ts, tie)."""
    last = F.max_by(F.struct(F.col(ts).alias("ts"), F.col(tie).alias("write_id"), F.col(value).alias("value")),
                    F.struct(F.col(ts), F.col(tie)))
    return writes.groupBy(*keys).agg(last.alias("_w")).select(*keys, "_w.ts", "_w.write_id", "_w.value")


def valid_entries(cache: DataFrame, as_of: Column, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """Entries whose age at ``as_of`` is strictly below the TTL."""
    return cache.filter(F.col("ts") > as_of - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS"))


def cache_hits(requests: DataFrame, cache: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """H3 hit branch: request keys with a valid entry, carrying the value."""
    return requests.select(*keys).distinct().join(valid_entries(cache, as_of), keys, "inner")


def cache_misses(requests: DataFrame, cache: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """H3 miss branch: request keys without a valid entry."""
    return requests.select(*keys).distinct().join(valid_entries(cache, as_of).select(*keys), keys, "left_anti")


def cache_evict(cache: DataFrame, keys: list[str], n: int = CACHE_MAX_ENTRIES) -> DataFrame:
    """H5: keep the newest ``n`` entries; ties by key."""
    return cache.orderBy(F.col("ts").desc(), *[F.col(k) for k in keys]).limit(n)


def dedupe_work(df: DataFrame, id_col: str, content: str, work) -> DataFrame:
    """H6: run ``work`` (DataFrame -> DataFrame keyed by ``_hash``) once per
    distinct content and join the result back to every row.

    ``work`` receives one row per distinct hash with columns
    (_hash, rep_id, <content>) and gives one row per hash. The smallest id of a
    hash is found over ids and hashes alone; only then are contents joined, so
    no aggregation holds them. Null contents have no hash and give no row."""
    d = df.select(id_col, content).withColumn("_hash", F.sha2(F.col(content), 256))
    first = d.where("_hash is not null").groupBy("_hash").agg(F.min(id_col).alias("rep_id")).withColumnRenamed("_hash", "_rh")
    reps = d.join(first, (F.col("_hash") == F.col("_rh")) & F.col(id_col).eqNullSafe(F.col("rep_id"))).select("_hash", "rep_id", content)
    # an id that repeats with its content is worked on twice, but answers once
    done = work(reps).dropDuplicates(["_hash"])
    return d.select(id_col, "_hash").join(done, "_hash", "inner")


# ---------------------------------------------------------------------- H7

def _checkpoint(df: DataFrame) -> DataFrame:
    """Materialise to the shared checkpoint folder (cuts the lineage)."""
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ttl_next(events: DataFrame, keys: list[str], ts: str, eid: str, ttl_seconds: int) -> DataFrame:
    """For every event e: the first event of its key at or after e.ts + ttl
    (order (ts, id)). An as-of lookup: probes are merged with the events and
    windowed per (key, hour of the probe time); a probe that finds nothing in
    its hour takes the first event of the next non-empty hour of the key,
    found on a small per-(key, hour) table. No window spans a whole key."""
    ttl = F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")
    ev = events.select(*keys, F.col(ts).alias("_t"), F.lit(1).alias("_typ"), F.col(eid).alias("_eid"),
                       F.lit(None).cast("long").alias("_src"))
    pr = events.select(*keys, (F.col(ts) + ttl).alias("_t"), F.lit(0).alias("_typ"),
                       F.lit(None).cast("long").alias("_eid"), F.col(eid).alias("_src"))
    u = ev.unionByName(pr).withColumn("_b", F.date_trunc("HOUR", F.col("_t")))
    cand = F.when(F.col("_typ") == 1, F.struct(F.col("_t").alias("t"), F.col("_eid").alias("id")))
    w = (Window.partitionBy(*keys, "_b").orderBy("_t", "_typ", "_eid")
         .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    local = u.withColumn("_hit", F.first(cand, ignorenulls=True).over(w)).filter(F.col("_typ") == 0)
    per_b = u.groupBy(*keys, "_b").agg(F.min(cand).alias("_bfirst"))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    nxt_b = per_b.select(*keys, "_b", F.first("_bfirst", ignorenulls=True).over(wb).alias("_later"))
    j = local.join(nxt_b, [*keys, "_b"], "left")
    return j.select(F.col("_src").alias("id"), F.coalesce(F.col("_hit"), F.col("_later"))["id"].alias("nxt"))


GROUP_FOLD_BOUND = 10_000


def _ttl_fold(events: DataFrame, keys: list[str], ts: str, eid: str, ttl_seconds: int) -> DataFrame:
    """Per-key fold for keys with a bounded number of events: sort the
    key's (time, id) pairs in the row and keep an event when it is at least
    ``ttl`` after the last kept one."""
    us = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col(ts))
    g = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(us.alias("t"), F.col(eid).alias("id"))))
                                  .alias("_ev"))
    ttl_us = int(ttl_seconds) * 1_000_000
    init = F.struct(F.lit(None).cast("long").alias("a"), F.array().cast("array<long>").alias("k"))

    def step(acc, x):
        keep = acc["a"].isNull() | (x["t"] - acc["a"] >= ttl_us)
        return F.struct(F.when(keep, x["t"]).otherwise(acc["a"]).alias("a"),
                        F.when(keep, F.concat(acc["k"], F.array(x["id"]))).otherwise(acc["k"]).alias("k"))
    kept = g.select(F.explode(F.aggregate("_ev", init, step, lambda a: a["k"])).alias(eid))
    return events.join(kept, eid, "left_semi")


def ttl_dedupe(events: DataFrame, keys: list[str], ts: str, eid: str,
               ttl_seconds: int = CACHE_TTL_SECONDS, span_seconds: float | None = None,
               bound: int = GROUP_FOLD_BOUND) -> DataFrame:
    """H7: keep an event when no *kept* event of its key is younger than the
    TTL (strict ``age < ttl`` is a hit; a hit does not renew the entry).

    Keys with at most ``bound`` events are folded in one row each (bounded
    memory). Larger keys never go to one task: kept events form a chain per
    key (the first event, then repeatedly the first event at least ``ttl``
    later, ``ttl_next``), followed by pointer doubling; ``ceil(log2(span/ttl
    + 2))`` rounds cover every chain, each two equi-joins on the event id,
    checkpointed. Returns the kept rows of ``events``.
    """
    from .ordered import follow_chains
    counts = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    largest = counts.agg(F.max("_cnt")).first()[0] or 0
    sized = events.join(counts, keys)
    out = _ttl_fold(sized.filter(F.col("_cnt") <= bound).drop("_cnt"), keys, ts, eid, ttl_seconds)
    if largest <= bound:
        return out
    big = sized.filter(F.col("_cnt") > bound).drop("_cnt")
    if span_seconds is None:
        r = big.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
        span_seconds = 0.0 if r["lo"] is None else (r["hi"] - r["lo"]).total_seconds()
    rounds = max(1, math.ceil(math.log2(span_seconds / ttl_seconds + 2)))
    jump = ttl_next(big, keys, ts, eid, ttl_seconds)
    first = big.groupBy(*keys).agg(F.min(F.struct(F.col(ts), F.col(eid))).alias("_f"))
    kept = follow_chains(jump, first.select(F.col(f"_f.{eid}").alias("id")), rounds, _checkpoint)
    return out.unionByName(big.join(kept.withColumnRenamed("id", eid), eid, "left_semi"))
