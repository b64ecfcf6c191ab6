"""Exact links inside groups of shingle sets, found in the tasks that hold the groups.

A group is a number of documents that may be similar, with their sets. Only links that join two components come out: at
most as many as members less one, however many pairs are similar. A large group is split into blocks; each two blocks meet in
one task, and a block holds a bounded number of members and of shingles (a longer set has a block of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members and shingles of one block, about.
BLOCK_ROWS = 2048
BLOCK_SHINGLES = 1 << 20


def block_count(members: Column, shingles: Column) -> Column:
    """Blocks of a group of so many members and shingles."""
    return F.greatest(F.ceil(members / F.lit(BLOCK_ROWS)), F.ceil(shingles / F.lit(BLOCK_SHINGLES)), F.lit(1)).cast("int")


def in_blocks(rows: DataFrame, blocks: Column, member: str) -> DataFrame:
    """Each row once for each pair of blocks (lo <= hi) that its own ``block`` is one of."""
    block = F.pmod(F.xxhash64(member, F.lit(BLOCK_ROWS)), blocks).cast("int")
    rows = rows.withColumns({"block": block, "_other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    return rows.withColumns({"lo": F.least("block", "_other"), "hi": F.greatest("block", "_other")}).drop("_other")


def grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """One table for each group; rows come in order of the key. Groups go on over batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in key]
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if held and any(held[-1].column(c)[held[-1].num_rows - 1] != batch.column(c)[0] for c in key):
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all ranges, one behind the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def _sums(flags: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over consecutive stretches of these lengths."""
    total = np.concatenate([[0], np.cumsum(flags)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def joining(label: np.ndarray, size: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, percent: int,
            at: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of members whose sets are similar, as few as join all components of ``label`` that similar sets join.

    size: of the whole sets, of which ``sets`` may leave out what no other set holds. side: True for members of the first of two
    blocks, which are only paired across. at: the place in each set of the shingle that made the group; a pair is verified only
    if neither shares a shingle before it, so that of all groups with both one verifies."""
    m = len(sets)
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    offsets = np.cumsum(lengths) - lengths
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    _, part = np.unique(label, return_inverse=True)
    mark, done, out = np.zeros(number.max(initial=0) + 1, dtype=bool), np.zeros(m, dtype=bool), []
    # every pair of two components has a member outside of the largest
    for x in np.flatnonzero(part != np.bincount(part).argmax()).tolist():
        fits = (part != part[x]) & ~done & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
        if side is not None:
            fits &= side != side[x]
        done[x] = True
        others = np.flatnonzero(fits)
        if at is not None and len(others):
            head = number[offsets[x]:offsets[x] + at[x]]
            mark[head] = True
            earlier = _sums(mark[number[_ranges(offsets[others], at[others])]], at[others])
            mark[head] = False
            others = others[earlier == 0]
        if not len(others):
            continue
        own = number[offsets[x]:offsets[x] + lengths[x]]
        mark[own] = True
        both = _sums(mark[number[_ranges(offsets[others], lengths[others])]], lengths[others])
        mark[own] = False
        similar = (both > 0) & (100 * both >= percent * (size[x] + size[others] - both))
        for y in others[similar].tolist():
            if part[y] != part[x]:
                out.append((x, y))
                part[part == part[y]] = part[x]
    return out


def links(percent: int, key: list[str]):
    """For mapInArrow: rows (key, lo, hi, block, doc_id, label, size, shingles, perhaps at) in order of key, lo, hi -> links a < b."""
    def run(batches):
        for group in grouped(batches, [*key, "lo", "hi"]):
            if group.num_rows < 2:
                continue
            doc, label, size, block = (group.column(c).to_numpy() for c in ("doc_id", "label", "size", "block"))
            sets = [np.frombuffer(s, dtype=np.uint64) for s in group.column("shingles").to_pylist()]
            lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
            at = group.column("at").to_numpy() if "at" in group.column_names else None
            found = joining(label, size, sets, None if lo == hi else block == lo, percent, at)
            if found:
                a, b = doc[[f[0] for f in found]], doc[[f[1] for f in found]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
    return run
