"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks of about ``block_rows`` rows; time runs in slots,
one block each. With all sources active, a source of weight w gets the share
w / (sum of weights) of the slots; when one is used up, the others share its part
in proportion. So after t slots a source is due an exact, fractional number of blocks. Its
k-th block is released when more than k - 1 are due and must run before k are; among
the released blocks the one with the earliest deadline runs. Each deadline is met, so
at every time the number of blocks run differs from the number due by less than one.

Every document is kept, once. A document's block follows from a hash of its id; the
schedule needs only the number of rows per source. Its size is bounded: there are at
most ``max_blocks`` blocks besides one partial block per source (a larger table gets
larger blocks), so it's worked out on the driver in exact integers and broadcast.

Defined results: a null source is a source of its own. Sources without a target
weight, or with one that isn't positive, run after all others, in order of name. Of
equal deadlines the source with the lower name runs first (null lowest). Rows of
one id and source share a block. Other columns are kept by ``mixed``, whatever their
names; an empty table gives an empty result. More than ``MAX_SOURCES`` sources are
an error, as the schedule is worked out in one place.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

MAX_SOURCES = 100_000


def schedule(sources: list[tuple[str | None, int, float]], start: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(source's place in the list, block, slot, release, deadline) of all blocks, by slot.

    sources: name, number of blocks, weight (positive), in order of name.
    """
    weights = [max(1, round(w * 1_000_000)) for _, _, w in sources]
    # a source is used up at virtual time blocks / weight; until then it is due weight blocks per unit
    ends = sorted(range(len(sources)), key=lambda s: Fraction(sources[s][1], weights[s]))
    # between two such times t(v) = done + active * v, where done counts the blocks of used-up sources
    jobs = []
    active, done, gone = sum(weights), 0, 0

    # walk the blocks' boundaries k / w in order of virtual time, so that each is placed by integers
    marks = [(Fraction(0), s, 0) for s in range(len(sources)) if sources[s][1]]
    heapq.heapify(marks)
    times: list[list[tuple[int, int]]] = [[] for _ in sources]  # (floor, ceiling) of the real time of each boundary
    while marks:
        v, s, k = heapq.heappop(marks)
        while gone < len(ends) and Fraction(sources[ends[gone]][1], weights[ends[gone]]) <= v:
            done += sources[ends[gone]][1]
            active -= weights[ends[gone]]
            gone += 1
        t = done + active * v
        times[s].append((t.numerator // t.denominator, -(-t.numerator // t.denominator)))
        if k < sources[s][1]:
            heapq.heappush(marks, (Fraction(k + 1, weights[s]), s, k + 1))
    for s, row in enumerate(times):
        for k in range(1, len(row)):
            jobs.append((row[k - 1][0], row[k][1], s, k))
    jobs.sort()
    out, ready, at, now = [], [], 0, 0
    while at < len(jobs) or ready:
        while at < len(jobs) and jobs[at][0] <= now:
            release, deadline, s, k = jobs[at]
            heapq.heappush(ready, (deadline, s, k, release))
            at += 1
        deadline, s, k, release = heapq.heappop(ready)
        out.append((s, k, start + now, start + release, start + deadline))
        now += 1
    return out


def plan(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = 1000, max_blocks: int = 20_000,
         source: str = "source") -> DataFrame:
    """source, blocks, block, slot, release, deadline: the whole schedule, at most ``max_blocks`` rows and one per source.

    Without ``weights`` each source's target is the square root of its number of rows, which raises small sources.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    total = sum(r["n"] for r in sizes)
    block = max(block_rows, -(-total // max_blocks))
    by_name = sorted(((r["source"], r["n"]) for r in sizes), key=lambda r: (r[0] is not None, r[0] or ""))
    blocks = {name: -(-n // block) for name, n in by_name}
    target = {name: n ** 0.5 for name, n in by_name} if weights is None else weights
    # weights are shares, so that rounding to integers loses little
    whole = sum(w for name, w in target.items() if w > 0 and name in blocks) or 1.0
    timed = [(name, blocks[name], target[name] / whole) for name, _ in by_name if target.get(name, 0) > 0]
    rows = [(timed[s][0], blocks[timed[s][0]], k, slot, release, deadline) for s, k, slot, release, deadline in schedule(timed)]
    for name, _ in by_name:
        if not target.get(name, 0) > 0:
            rows += [(name, blocks[name], k, len(rows) + k - 1, len(rows) + k - 1, len(rows) + k) for k in range(1, blocks[name] + 1)]
    kinds = [("source", pa.string()), ("blocks", pa.int64()), ("block", pa.int64()), ("slot", pa.int64()), ("release", pa.int64()), ("deadline", pa.int64())]
    return spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds)}))


def slots(docs: DataFrame, planned: DataFrame, source: str = "source", key: str = "doc_id", prefix: str = "mix_") -> DataFrame:
    """``docs`` with mix_block, mix_slot, mix_release and mix_deadline (columns of these names are replaced)."""
    docs = docs.drop(*[prefix + n for n in ("block", "slot", "release", "deadline")])
    s, n, t, b = free_names(docs, "_s", "_n", "_t", "_b")
    total = F.broadcast(planned.select(F.col("source").alias(s), F.col("blocks").alias(n)).distinct())
    at = F.broadcast(planned.select(F.col("source").alias(t), *[F.col(n).alias(prefix + n) for n in ("block", "slot", "release", "deadline")]))
    rows = docs.join(total, docs[source].eqNullSafe(F.col(s))).drop(s)
    rows = rows.withColumn(b, _block(F.col(key), F.col(n))).drop(n)
    return rows.join(at, rows[source].eqNullSafe(F.col(t)) & (F.col(b) == F.col(f"{prefix}block"))).drop(t, b)


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(10)), blocks) + 1


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = 1000, max_blocks: int = 20_000,
          source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` in the order of the schedule: by slot, and within a block by a hash of the id. One shuffle, by ranges of slots."""
    columns, prefix = docs.columns, "_mixing_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    slot = f"{prefix}slot"
    rows = slots(docs, plan(docs, weights, block_rows, max_blocks, source), source, key, prefix)
    turn = F.xxhash64(F.col(key), F.lit(11))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, slot, turn).sortWithinPartitions(slot, turn).select(*columns)
