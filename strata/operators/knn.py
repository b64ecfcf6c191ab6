"""Nearest neighbours between two tables of vectors (X2, X3 exact; X6 approximate).

Vectors are dealt to the cell of their nearest pivot. Pivots are a bounded
sample of the corpus (at most ``MAX_PIVOTS`` vectors, the only vectors that the
driver holds); every vector of the corpus is in a cell. Cells fall into blocks
of about ``BLOCK_ROWS`` vectors, so a cell of many equal vectors is spread over
tasks. A task holds one block and streams the queries that visit it, or a part of
them: a block that many queries visit goes with a copy to each part. A query
leaves a block with its ``k`` nearest of that block, and a window merges them.

In a task one matrix product gives the distances of many pairs, rounded to single
precision; pairs that the bound of this rounding leaves in question, few per query,
get their distance summed in double. Of equal vectors a block keeps the ``k`` smallest ids.

Exact (``knn_exact``): first every query visits one block of its own cell, and
the k-th distance found there bounds its answer. A cell whose pivot is at
distance d and whose farthest member is at r holds nothing nearer than d - r,
so the second visits are only to the blocks of cells with d - r within the
bound. Approximate (``knn_approximate``): the pivots are moved to the means of
their sample (a coarse quantiser), and a query visits the ``probes`` nearest
cells.

Groups (X3): cells, blocks and bounds are those of the query's group, so hot
groups are spread like all others. Rows with a null id, vector or group take no
part; ids are unique in each table. A query gets as many neighbours as its group
has, k at most; distances are summed in double in the order of the dimensions,
ties go to the smaller id. Empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

#: Vectors of a block, and of a part of its queries; the number of pivots is such that a cell has about one block, up to the bound.
BLOCK_ROWS = 32_768
#: Numbers in the vectors of a block: vectors of many dimensions make smaller blocks.
BLOCK_VALUES = 1 << 22
MAX_PIVOTS = 4096
#: Sample that the coarse quantiser is fitted on, and how often its centres move.
QUANTISER_ROWS, QUANTISER_ROUNDS = 16_384, 8
#: Cells of the distance arrays held at a time.
CELLS = 1 << 21
#: Pairs that get an exact distance at a time.
PAIRS = 1 << 16
#: So many times k members in question for a query, on average: then its bound is narrowed first.
NARROW = 16
#: Longer vectors don't fit single precision: all their pairs are summed.
LONG = 1e15


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _to_pivots(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots; only for bounds and cells, so rounding errors don't matter there."""
    d = (a * a).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * a @ pivots.T
    return np.sqrt(np.maximum(d, 0))


def _rows(df: DataFrame, id_col: str, vec_col: str, group_col: str | None) -> DataFrame:
    group = F.col(group_col).cast("string") if group_col else F.lit("")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), group.alias("grp"), F.col(vec_col).alias("vec"))
    return rows.where("id is not null and vec is not null and grp is not null")


def sample(rows: DataFrame, n: int) -> np.ndarray:
    """n vectors, those of the smallest hash of their id."""
    got = rows.select("vec").orderBy(F.xxhash64("id"), "id").limit(n).toArrow()
    return _matrix(got.column("vec").combine_chunks()) if got.num_rows else np.zeros((0, 1))


def _assigned(rows: DataFrame, shared) -> DataFrame:
    """The rows with their cell and their distance to its pivot."""
    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                d = _to_pivots(_matrix(batch.column("vec")), shared.value)
                cell = d.argmin(axis=1)
                yield batch.append_column("cell", pa.array(cell.astype(np.int32))).append_column("far", pa.array(d[np.arange(len(d)), cell]))
    vec = rows.schema["vec"].dataType.simpleString()
    return rows.mapInArrow(assign, f"id bigint, grp string, vec {vec}, cell int, far double")


def _in_block(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """The rows with the block of their cell that their id belongs to; rows whose cell is empty have none."""
    return rows.join(cells.select("grp", "cell", "blocks"), ["grp", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


_FOUND = "query_id bigint, neighbor_id bigint, d2 double"


def _exact(vecs: np.ndarray, members: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Squared distances of pairs, summed in the order of the dimensions."""
    out = np.zeros(len(q))
    for lo in range(0, len(q), PAIRS):
        x, y = vecs[q[lo:lo + PAIRS]], members[m[lo:lo + PAIRS]]
        for j in range(x.shape[1]):
            diff = x[:, j] - y[:, j]
            out[lo:lo + PAIRS] += diff * diff
    return out


class _Block:
    """Members of a block, for the k nearest of queries. With members b shifted by their mean, the product of (a, 1) and (b, -|b|^2 / 2)
    is (|a|^2 - distance^2) / 2; it is rounded by ``slack`` at most."""

    def __init__(self, ids: list, vecs: list, k: int):
        ids, vecs = np.concatenate(ids), np.concatenate(vecs)
        order = np.argsort(ids, kind="stable")
        # what isn't finite is at no distance
        order = order[np.isfinite(vecs[order]).all(axis=1)]
        ids, vecs = ids[order], np.ascontiguousarray(vecs[order])
        # of equal vectors only the k smallest ids can be among the k nearest
        if vecs.size:
            same = np.unique(vecs.view(np.dtype((np.void, vecs.itemsize * vecs.shape[1]))).ravel(), return_inverse=True)[1].ravel()
            by = np.argsort(same, kind="stable")
            first = np.searchsorted(same[by], same[by])
            keep = np.sort(by[np.arange(len(by)) - first < k])
            ids, vecs = ids[keep], vecs[keep]
        self.k, self.ids, self.vecs = k, ids, vecs
        if not len(ids):
            return
        with np.errstate(all="ignore"):
            self.mean = vecs.mean(axis=0)
            b = vecs - self.mean
            half = (b * b).sum(axis=1) / 2
            self.longest = math.sqrt(2 * half.max())
            self.right = np.concatenate([b, -half[:, None]], axis=1).astype(np.float32).T.copy()

    def best(self, ids, vecs, bounds):
        k = self.k
        with np.errstate(all="ignore"):
            a = vecs - self.mean
            long = np.sqrt((a * a).sum(axis=1))
            value = np.concatenate([a, np.ones((len(a), 1))], axis=1).astype(np.float32) @ self.right
            # sums of n rounded products, each term rounded before; doubled for the rounding of this bound
            slack = (a.shape[1] + 8) * 2.0 ** -23 * (long * self.longest + self.longest ** 2 / 2) + 2.0 ** -23 * long ** 2 + 1e-30
            least = (long ** 2 - bounds) / 2 - slack
            if max(self.longest, long.max()) < LONG:
                maybe = value >= _below(least)
                if np.count_nonzero(maybe) > NARROW * k * len(a):
                    maybe = value >= _below(np.maximum(least, self._kth(value) - 2 * slack))
            else:
                maybe = np.ones(value.shape, dtype=bool)
        q, m = np.divmod(np.flatnonzero(maybe), value.shape[1])
        d2 = _exact(vecs, self.vecs, q, m)
        go = np.isfinite(d2) & (d2 <= bounds[q])
        q, m, d2 = q[go], m[go], d2[go]
        # members stand in the order of their ids
        order = np.lexsort((m, d2, q))
        q, m, d2 = q[order], m[order], d2[order]
        go = np.arange(len(q)) - np.searchsorted(q, q) < k
        return pa.RecordBatch.from_arrays([pa.array(ids[q[go]]), pa.array(self.ids[m[go]]), pa.array(d2[go])], names=["query_id", "neighbor_id", "d2"])

    def _kth(self, value: np.ndarray) -> np.ndarray:
        """A value that k members at least reach: the k-th of the largest ones of shares of the members."""
        shares = min(value.shape[1], 32 * self.k)
        if shares < self.k:
            return np.full(len(value), -np.inf)
        cuts = np.arange(shares) * value.shape[1] // shares
        top = np.maximum.reduceat(value, cuts, axis=1)
        return np.partition(top, shares - self.k, axis=1)[:, shares - self.k].astype(np.float64)


def _below(least: np.ndarray) -> np.ndarray:
    """The bounds of rows as single precision, rounded down."""
    return np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]


def _nearest(k: int):
    """Rows (grp, cell, block, part, role, id, vec, bound) in order: a block's members (role 0), then a part of its queries -> the k nearest
    members of each query that are within its bound."""
    def nearest(batches):
        key, ids, vecs, held = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, role = batch.column("grp").to_numpy(zero_copy_only=False), batch.column("role").to_numpy()
            cell, block, share = (batch.column(c).to_numpy() for c in ("cell", "block", "part"))
            edges = np.flatnonzero((grp[1:] != grp[:-1]) | (cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (share[1:] != share[:-1])
                                   | (role[1:] != role[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                if (now := (grp[lo], cell[lo], block[lo], share[lo])) != key:
                    key, ids, vecs, held = now, [], [], None
                if not role[lo]:
                    ids.append(part.column("id").to_numpy())
                    vecs.append(_matrix(part.column("vec")))
                elif ids or held:
                    if held is None:
                        held, ids, vecs = _Block(ids, vecs, k), [], []
                    asked, at, bound = part.column("id").to_numpy(), _matrix(part.column("vec")), part.column("bound").to_numpy()
                    if not len(held.ids):
                        continue
                    step = max(1, CELLS // len(held.ids))
                    for x in range(0, len(asked), step):
                        yield held.best(asked[x:x + step], at[x:x + step], bound[x:x + step])
    return nearest


def _visit(members: DataFrame, visits: DataFrame, asked: DataFrame, by: list[str], k: int) -> DataFrame:
    """query_id, neighbor_id, d2 of the k nearest members of each block that a query visits. asked: of the queries, the columns ``by``: no block
    is visited by more queries than have its values there, so as many parts share them."""
    cols = ["grp", "cell", "block", "part", "role", "id", "vec", "bound"]
    parts = asked.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("parts"))
    rows = members.join(parts, by).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("grp", "cell", "block", "part", F.lit(0).alias("role"), "id", "vec", F.lit(0.0).alias("bound")).select(cols)
    part = F.pmod(F.xxhash64("id", F.lit(BLOCK_ROWS)), F.col("parts")).cast("int")
    rows = rows.union(visits.join(parts, by).withColumns({"part": part, "role": F.lit(1)}).select(cols))
    key = ["grp", "cell", "block", "part"]
    return rows.repartition(*key).sortWithinPartitions(*key, "role").mapInArrow(_nearest(k), _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("d2", "neighbor_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "neighbor_id", F.round(F.sqrt("d2"), 6).alias("dist")))


class _Index:
    """The corpus in cells and blocks, written once."""

    def __init__(self, rows: DataFrame, pivots: np.ndarray):
        self.shared = rows.sparkSession.sparkContext.broadcast(pivots)
        dealt = _written(_assigned(rows, self.shared), "knn-cells")
        most = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(1, pivots.shape[1])))
        blocks = F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int")
        self.cells = _written(dealt.groupBy("grp", "cell").agg(F.max("far").alias("radius"), blocks.alias("blocks")), "knn-stats")
        self.members = _in_block(dealt, self.cells)

    def visits(self, queries: DataFrame, wanted, vec: str, grouped: bool) -> DataFrame:
        """A row for each block that a query visits. wanted: of the distances to the cells' pivots, the cells' radii and the query's bound -> a
        mask of cells. Without groups all queries see the same cells, at most ``MAX_PIVOTS``; with groups the cells of theirs come by a join."""
        shared, cols = self.shared, ["grp", "id", "vec", "home", "home_block", "bound"]
        if grouped:
            cells = self.cells.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("cell", "radius", "blocks"))).alias("cells"))
            queries, common = queries.select(cols).join(cells, "grp").select(*cols, "cells"), None
        else:
            queries, common = queries.select(cols), [r.asDict() for r in self.cells.orderBy("cell").collect()]

        def visit(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                d, which, blocks = _to_pivots(_matrix(batch.column("vec")), shared.value), [], []
                cells = batch.column("cells").to_pylist() if common is None else [common] * batch.num_rows
                bound = batch.column("bound").to_pylist()
                home = batch.column("home").to_numpy(), batch.column("home_block").to_numpy()
                cell = None
                for row, own in enumerate(cells):
                    if cell is None or common is None:
                        cell, radius, n = (np.array([c[x] for c in own], dtype=t) for x, t in (("cell", np.int64), ("radius", float), ("blocks", np.int64)))
                    go = np.flatnonzero(wanted(d[row][cell], radius, bound[row]))
                    which += [(row, c, b) for c, m in zip(cell[go].tolist(), n[go].tolist()) for b in range(m) if (c, b) != (home[0][row], home[1][row])]
                row, cell, block = (np.array(x, dtype=np.int32) for x in (zip(*which) if which else ([], [], [])))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("grp").take(take), pa.array(cell), pa.array(block), batch.column("id").take(take),
                                                  batch.column("vec").take(take), batch.column("bound").take(take)], names=["grp", "cell", "block", "id", "vec", "bound"])
        return queries.mapInArrow(visit, f"grp string, cell int, block int, id bigint, vec {vec}, bound double")


def knn_exact(corpus: DataFrame, id_col: str, vec_col: str, k: int, queries: DataFrame | None = None, group_col: str | None = None) -> DataFrame:
    """(query_id, rank, neighbor_id, dist) of the k nearest vectors of the corpus, for every query (by default the corpus itself);
    with ``group_col`` of the query's group only."""
    ship_package(corpus.sparkSession)
    rows = _rows(corpus, id_col, vec_col, group_col)
    vec = rows.schema["vec"].dataType.simpleString()
    asked = _rows(corpus if queries is None else queries, id_col, vec_col, group_col).withColumn("vec", F.col("vec").cast(vec))
    index = _Index(rows, sample(rows, min(MAX_PIVOTS, max(1, math.ceil(rows.count() / BLOCK_ROWS)))))
    # one block of its own cell bounds the distance of each query's k-th neighbour
    asked = _written(_home(asked, index), "knn-queries")
    first = asked.where("home_block >= 0").select("grp", F.col("home").alias("cell"), F.col("home_block").alias("block"), "id", "vec", F.lit(math.inf).alias("bound"))
    near = _written(_visit(index.members, first, first.select("grp", "cell", "block"), ["grp", "cell", "block"], k), "knn-near")
    bound = near.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.max("d2")).alias("kth"))
    asked = asked.join(bound, "id", "left").withColumn("bound", F.coalesce("kth", F.lit(math.inf)))

    def reachable(distance, radius, bound):
        return distance - radius <= math.sqrt(bound) * (1 + 1e-9) + 1e-6  # the distances to pivots are rounded
    visits = index.visits(asked, reachable, vec, group_col is not None)
    return _top(near.union(_visit(index.members, visits, asked.select("grp"), ["grp"], k)), k)


def _home(asked: DataFrame, index: _Index) -> DataFrame:
    """The queries with the nearest cell and the block of it that they visit first; -1 if their group has nothing there."""
    dealt = _assigned(asked, index.shared).drop("far")
    placed = dealt.join(index.cells.select("grp", "cell", "blocks"), ["grp", "cell"], "left")
    block = F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.lit(-1))
    return placed.select("id", "grp", "vec", F.col("cell").alias("home"), block.alias("home_block"))


def quantiser(rows: DataFrame, cells: int) -> np.ndarray:
    """Centres fitted on ``QUANTISER_ROWS`` vectors: those nearest to a centre move it to their mean."""
    vectors = sample(rows, QUANTISER_ROWS)
    centres = vectors[:cells].copy()
    for _ in range(QUANTISER_ROUNDS):
        own = _to_pivots(vectors, centres).argmin(axis=1) if len(centres) else np.zeros(0, np.int64)
        n = np.bincount(own, minlength=len(centres))
        for j in np.flatnonzero(n).tolist():
            centres[j] = vectors[own == j].mean(axis=0)
    return centres


def knn_approximate(corpus: DataFrame, id_col: str, vec_col: str, k: int, queries: DataFrame, cells: int = 256, probes: int = 96) -> DataFrame:
    """(query_id, rank, neighbor_id, dist) of the k nearest vectors in the ``probes`` nearest of ``cells`` inverted lists. The lists hold
    every vector of the corpus; only their centres are fitted on a sample."""
    ship_package(corpus.sparkSession)
    rows = _rows(corpus, id_col, vec_col, None)
    vec = rows.schema["vec"].dataType.simpleString()
    index = _Index(rows, quantiser(rows, min(cells, MAX_PIVOTS)))
    asked = _rows(queries, id_col, vec_col, None).withColumn("vec", F.col("vec").cast(vec))
    # written: joined on the one group as a literal, Spark would plan a cross join
    asked = _written(asked.withColumns({"home": F.lit(-1), "home_block": F.lit(-1), "bound": F.lit(math.inf)}), "knn-queries")

    def nearest(distance, radius, bound):
        go = np.zeros(len(distance), dtype=bool)
        go[np.argsort(distance, kind="stable")[:probes]] = True
        return go
    visits = index.visits(asked, nearest, vec, False)
    return _top(_visit(index.members, visits, asked.select("grp"), ["grp"], k), k)
