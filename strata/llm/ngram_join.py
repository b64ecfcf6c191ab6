"""Similarity join of documents by the Jaccard similarity of their word n-grams.

1. *Sets*: the distinct n-grams of each whole text, as 64-bit hashes. Documents of one set fold into a class, whose smallest
   id represents it.
2. *Alive*: two similar sets share the first k of their common n-grams in any order, and those stand among the n - ceil(0.8 n) + k
   first of each. So of each set the n-grams of smallest hash are counted, with k a fifth of n, and a document goes on only if enough
   of them are held by another one; nothing is lost. The n-grams travel packed, a block of documents at a time, to the task that counts
   their range of hashes, and only numbers per document come back. An n-gram that several documents of a block hold is sent
   once, so a very common one makes a row per block.
   The texts of those that go on are read again, behind a fixed-size bit table of their ids.
3. *Rare first*: for them, how many classes hold each n-gram. Each set is put in order of that number (ties by
   hash). What only one class holds comes first and never joins, so of the prefix of n - ceil(0.8 n) + 1 n-grams only the rest is
   exposed.
4. *Prefix join*: the exposed n-grams group the classes. In a group, a pair goes where a filter rules it out. Length: sizes
   too far apart. Position: behind the group's n-gram, the first that both share, too few n-grams are left. Suffix: the order of
   hashes is cut into fixed ranges; the differences of the numbers of n-grams in them, and those that only one class holds,
   add up to more than two similar sets may differ by.
5. *Star*: of each group the pairs of its smallest document with all others are verified on the full sets. Most large families of near
   copies are one component after that.
6. *Rest*: groups that still hold several components are compared whole, block by block, by the filters; a member is dealt
   on with its set if any pair with another component passes. Then pairs of different components are verified in the
   task, each in the group of its first shared n-gram alone, and only links that join two components come out.

So rows grow with exposed n-grams, not with pairs, and each pair of different texts is either ruled out by an exact bound,
verified, or known to be joined by links already. Step 6 verifies a pair in one group only; what may be verified again there is a
pair of the star that wasn't similar.

Defined results: words are the runs of characters other than ASCII white space, A-Z in lower case; a text with fewer words
than an n-gram is one n-gram of all its words; null text or text without words has an empty set and links with nothing. Rows
of one id count as one document, which links by any of its texts. A null id links with nothing; its row is kept with a null
component. Other columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from .common import prepare, text_blocks, written
from .linking import block_count, grouped, in_blocks, links
from .minhash import components, joined, shingles

#: Ranges of the suffix filter.
RANGES = 128
#: Cells of the arrays that compare two blocks at a time.
CELLS = 1 << 18


def prefix(n: int, percent: int) -> int:
    """So many n-grams in any order: two sets that are similar share one of them."""
    return n - -(-percent * n // 100) + 1


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def common(n: int) -> int:
    """k of step 2: of the first n-grams of a set of n."""
    return max(1, n // 5)


#: n-grams and documents that a block holds, about. Documents are numbered in 16 bits; the last number stands for several.
BLOCK_GRAMS, BLOCK_DOCS, SEVERAL = 1 << 20, 60_000, 65_535
#: kind 1: numbers of a block's documents with n-grams (on the way there) or credits (on the way back); kind 2: a document.
_PACKED = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()),
                     ("class", pa.binary()), ("credit", pa.int64()), ("owners", pa.binary()), ("grams", pa.binary())])
_PACKED_SQL = "part int, block bigint, kind int, place int, doc_id bigint, n bigint, class binary, credit bigint, owners binary, grams binary"


def _in_order(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the n-grams, and where each is first, in that order; the end comes last."""
    order = np.argsort(grams, kind="stable")
    sorted_ = grams[order]
    return order, np.append(np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(grams) else np.zeros(0, np.int64), len(grams))


def _scatter(size, percent, parts):
    """Documents -> a row for each, and the first n-grams of each block by range of hash."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)

    def block_rows(block, docs, first):
        owner = np.repeat(np.arange(len(docs)), [len(x) for x in first])
        grams = np.concatenate(first)
        order, starts = _in_order(grams)
        held = np.diff(starts)
        alone = np.repeat(held, held) == 1
        credit = np.bincount(owner[order][~alone], minlength=len(docs))
        sent = grams[order][starts[:-1]]
        owners = np.where(held == 1, owner[order][starts[:-1]], SEVERAL).astype("<u2")
        rows = [(i % parts, block, 2, i, *d, c, None, None) for i, (d, c) in enumerate(zip(docs, credit.tolist()))]
        cuts = [0, *np.searchsorted(sent, edges).tolist(), len(sent)]
        rows += [(part, block, 1, None, None, None, None, None, owners[x:y].tobytes(), sent[x:y].tobytes())
                 for part, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
        for lo in range(0, len(rows), 1000):
            yield _batch(rows[lo:lo + 1000], _PACKED)

    def scatter(batches):
        block, docs, first, total = TaskContext.get().partitionId() << 32, [], [], 0
        for batch, texts in text_blocks(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                s = shingles(text, size)
                known = len(s) and doc is not None
                docs.append((doc, len(s), hashlib.sha256(s.tobytes()).digest()[:16] if known else None))
                # hashes are sorted
                first.append(s[:prefix(len(s), percent) - 1 + common(len(s))] if known else s[:0])
                total += len(first[-1])
                if total >= BLOCK_GRAMS or len(docs) == BLOCK_DOCS:
                    yield from block_rows(block, docs, first)
                    block, docs, first, total = block + 1, [], [], 0
        if docs:
            yield from block_rows(block, docs, first)
    return scatter


def _gather(batches):
    """The n-grams of a range from all blocks -> per block how many of them each document shares with another block. Rows of documents pass."""
    blocks, owners, grams = [], [], []
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        yield batch.filter(pa.array(kinds == 2))
        packed = batch.filter(pa.array(kinds == 1))
        blocks += packed.column("block").to_pylist()
        owners += [np.frombuffer(x, dtype="<u2") for x in packed.column("owners").to_pylist()]
        grams += [np.frombuffer(x, dtype=np.uint64) for x in packed.column("grams").to_pylist()]
    if not blocks:
        return
    order, starts = _in_order(np.concatenate(grams))
    held = np.diff(starts)
    shared = np.zeros(len(order), dtype=bool)
    shared[order] = np.repeat(held, held) > 1
    cuts = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
    for block, own, lo, hi in zip(blocks, owners, cuts[:-1], cuts[1:]):
        mine, n = np.unique(own[shared[lo:hi]], return_counts=True)
        mine, n = mine[mine != SEVERAL], n[mine != SEVERAL]
        if len(mine):
            yield _batch([(0, block, 1, None, None, None, None, None, mine.astype("<u2").tobytes(), n.astype("<u8").tobytes())], _PACKED)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.binary()), ("alive", pa.bool_())])


def _alive(percent):
    """Rows in order of block and kind: credits come before documents."""
    def alive(batches):
        block = credits = None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["block"] != block:
                    block, credits = r["block"], np.zeros(SEVERAL, dtype=np.int64)
                if r["kind"] == 1:
                    credits[np.frombuffer(r["owners"], dtype="<u2")] += np.frombuffer(r["grams"], dtype="<i8")
                else:  # a similar set has at least that share of this one's size
                    need = common(-(-percent * r["n"] // 100))
                    rows.append((r["doc_id"], r["n"], r["class"], bool(r["class"] and r["credit"] + credits[r["place"]] >= need)))
            yield _batch(rows, _SKETCH)
    return alive


def sketch_of(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, class and alive of every row of ``docs`` (doc_id, text)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.mapInArrow(_scatter(size, percent, parts), _PACKED_SQL).repartitionById(parts, F.col("part")).mapInArrow(_gather, _PACKED_SQL)
    rows = written(packed, "grams-packed").repartition("block").sortWithinPartitions("block", "kind")
    return rows.mapInArrow(_alive(percent), "doc_id bigint, n bigint, class binary, alive boolean")


_SETS = pa.schema([("node", pa.int64()), ("grams", pa.list_(pa.int64()))])


def _sets(size):
    def sets(batches):
        for batch, texts in text_blocks(batches):
            rows = []
            for node, wanted, text in zip(batch.column("node").to_pylist(), batch.column("class").to_pylist(), texts):
                s = shingles(text, size)
                if hashlib.sha256(s.tobytes()).digest()[:16] == wanted:  # the id may have other texts
                    rows.append((node, s.view(np.int64)))
            yield _batch(rows, _SETS)
    return sets


_ORDERED = pa.schema([("node", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("alone", pa.int64()), ("shingles", pa.binary()),
                      ("ranges", pa.binary()), ("exposed", pa.list_(pa.int64()))])


def _ordered(percent):
    """grams: those that several classes hold, the rarest first."""
    def ordered(batches):
        for batch in batches:
            rows = []
            for key, rep, n, grams in zip(*(batch.column(c) for c in ("node", "rep", "n", "grams"))):
                s = grams.values.to_numpy().view(np.uint64)
                n = n.as_py()
                count = np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=RANGES)
                alone = n - len(s)
                rows.append((key.as_py(), rep.as_py(), n, alone, s.tobytes(), np.minimum(count, 255).astype(np.uint8).tobytes(),
                             s[:max(0, prefix(n, percent) - alone)].view(np.int64)))
            yield _batch(rows, _ORDERED)
    return ordered


def may_link(one: dict, two: dict, percent: int) -> np.ndarray:
    """Whether members may be similar whose first shared n-gram stands at place ``at`` of each; arrays that broadcast.

    n, alone: size of the set, and what only its class holds; at: behind what stands before it, ``alone`` included; ranges:
    numbers of the shared n-grams by range of hash."""
    n = one["n"] + two["n"]
    fits = 100 * np.minimum(one["n"], two["n"]) >= percent * np.maximum(one["n"], two["n"])
    most = 1 + np.minimum(one["n"] - one["at"], two["n"] - two["at"]) - 1
    fits &= (100 + percent) * most >= percent * n
    apart = one["alone"] + two["alone"] + np.abs(one["ranges"].astype(np.int16) - two["ranges"]).sum(axis=-1, dtype=np.int64)
    return fits & ((100 + percent) * apart <= (100 - percent) * n)


def _columns(table, names=("n", "alone", "at")) -> dict:
    out = {c: table.column(c).to_numpy() for c in names}
    data = b"".join(table.column("ranges").to_pylist())
    return out | {"ranges": np.frombuffer(data, dtype=np.uint8).reshape(-1, RANGES)}


def _star(percent):
    """Rows of members beside their group's center -> the pairs that may link."""
    def star(batches):
        for batch in batches:
            center = pa.Table.from_arrays(list(batch.column("center").flatten()), names=[f.name for f in batch.schema.field("center").type])
            keep = pa.array(may_link(_columns(batch), _columns(center), percent))
            yield pa.RecordBatch.from_arrays([center.column("node").combine_chunks().filter(keep), batch.column("node").filter(keep)], names=["center", "node"])
    return star


def _verify_star(percent):
    """Rows (center, salt, role, rep, n, shingles) in order: a center before its members -> links."""
    def verify(batches):
        rep = n = own = None
        for batch in batches:
            out = []
            for role, doc, size, s in zip(*(batch.column(c).to_pylist() for c in ("role", "rep", "n", "shingles"))):
                s = np.frombuffer(s, dtype=np.uint64)
                if not role:
                    rep, n, own = doc, size, np.sort(s)
                    continue
                place = np.minimum(np.searchsorted(own, s), len(own) - 1)
                both = int((own[place] == s).sum()) if len(own) else 0
                if both and 100 * both >= percent * (n + size - both):
                    out.append((min(rep, doc), max(rep, doc)))
            yield _batch(out, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    return verify


#: Bits of the filter of alive ids: what is broadcast is bounded by it. When most bits are set it lets most texts pass, and the join below decides.
FILTER_BITS = 1 << 27


def may_hold(ids: DataFrame, column: str):
    """A condition on an id that holds for all ids of the column, and for few others while there are far fewer ids than bits."""
    bit = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    words = (ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow())  # a row per word at most
    table = np.zeros(FILTER_BITS >> 6, dtype=np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def known(bit: pd.Series) -> pd.Series:
        b = bit.to_numpy()
        return pd.Series((shared.value[b >> 6] >> (b & 63)) & 1 == 1)
    return lambda c: known(F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)))


def star_links(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among ``edges`` (center, node). A center's members are dealt in blocks, each with a copy of its set."""
    sets = sets.select("node", "rep", "n", "shingles")
    blocks = edges.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / linking.BLOCK_ROWS).cast("int").alias("blocks"))
    members = edges.join(blocks, "center").select("center", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("salt"), F.lit(1).alias("role"), "node")
    centers = blocks.select("center", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("center").alias("node"))
    rows = members.union(centers).join(sets, "node").drop("node")
    return (rows.repartition("center", "salt").sortWithinPartitions("center", "salt", "role")
            .mapInArrow(_verify_star(percent), "a bigint, b bigint"))


def _open(percent):
    """Members (gram, lo, hi, block, node, label, n, alone, at, ranges) in order of the group -> those of a pair of components that may link."""
    names = ["gram", "lo", "hi", "block", "node", "label", "at"]

    def run(batches):
        for group in grouped(batches, ["gram", "lo", "hi"]):
            lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
            block, label, cols = group.column("block").to_numpy(), group.column("label").to_numpy(), _columns(group)
            left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            keep = np.zeros(len(block), dtype=bool)
            there = {c: v[right][None] for c, v in cols.items()}
            step = max(1, CELLS // max(1, len(right) * RANGES))
            for x in range(0, len(left), step):
                part = left[x:x + step]
                fits = label[part][:, None] != label[right][None]
                if fits.any():
                    fits &= may_link({c: v[part][:, None] for c, v in cols.items()}, there, percent)
                    keep[part] |= fits.any(axis=1)
                    keep[right] |= fits.any(axis=0)
            if keep.any():
                yield from group.select(names).filter(pa.array(keep)).to_batches()
    return run


def join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) for every row of ``docs`` (doc_id, text).

    Two documents link if 100 * shared n-grams >= percent * n-grams of either."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketch = written(sketch_of(docs, size, percent), "grams-sketch")
    ids = sketch.where("class is not null")
    folded = written(ids.groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("alive").alias("alive")), "grams-folded")
    same = (ids.select("doc_id", "class").join(folded.select("class", "rep"), "class").where("doc_id <> rep")
            .select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct())
    same = written(same, "grams-same")
    nodes = written(folded.where("alive").select(F.monotonically_increasing_id().alias("node"), "rep", "n", "class"), "grams-nodes")
    texts = docs.where("doc_id is not null").where(may_hold(nodes, "rep")("doc_id"))  # few other texts are shuffled
    sets = texts.join(nodes.select("node", F.col("rep").alias("doc_id"), "class"), "doc_id").mapInArrow(_sets(size), "node bigint, grams array<bigint>")
    sets = written(sets, "grams-sets")
    # 3. rare first
    rows = sets.select("node", F.explode("grams").alias("gram"))
    held = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = (rows.join(held, "gram").groupBy("node").agg(F.sort_array(F.collect_set(F.struct("held", "gram"))).alias("x"))
              .select("node", F.col("x.gram").alias("grams")))
    ordered = shared.join(nodes.select("node", "rep", "n"), "node").mapInArrow(
        _ordered(percent), "node bigint, rep bigint, n bigint, alone bigint, shingles binary, ranges binary, exposed array<bigint>")
    ordered = written(ordered.where("size(exposed) > 0"), "grams-ordered")
    # 4. prefix join
    exposed = ordered.select("node", "rep", "n", "alone", "ranges", F.posexplode("exposed").alias("at", "gram")).withColumn("at", F.col("alone") + F.col("at"))
    me = F.struct("rep", "node", "n", "alone", "at", "ranges")
    groups = exposed.groupBy("gram").agg(F.min(me).alias("center"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = written(exposed.join(groups, "gram"), "grams-members")
    # 5. star
    edges = members.where("node <> center.node").select("node", "n", "alone", "at", "ranges", "center")
    edges = written(edges.mapInArrow(_star(percent), "center bigint, node bigint").distinct(), "grams-star")
    labels = components(written(star_links(edges, ordered, percent), "grams-links").union(same), "grams-labels")
    # 6. the rest
    rows = members.drop("center").join(labels.select(F.col("doc_id").alias("rep"), F.col("component_id").alias("label")), "rep", "left")
    rows = rows.withColumn("label", F.coalesce("label", "rep"))
    several = rows.groupBy("gram").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.sum("n").alias("grams")).where("l0 < l1").select("gram", "grams")
    rows = in_blocks(rows.join(several, "gram"), block_count(F.col("m"), F.col("grams")), "node")
    left = rows.select("gram", "lo", "hi", "block", "node", "label", "n", "alone", "at", "ranges").repartition("gram", "lo", "hi").sortWithinPartitions("gram", "lo", "hi")
    left = written(left.mapInArrow(_open(percent), "gram bigint, lo int, hi int, block int, node bigint, label bigint, at bigint"), "grams-open")
    left = left.join(ordered.select("node", "rep", "n", "alone", "shingles"), "node").select(
        "gram", "lo", "hi", "block", F.col("rep").alias("doc_id"), "label", F.col("n").alias("size"), "shingles", (F.col("at") - F.col("alone")).alias("at"))
    new = (left.repartition("gram", "lo", "hi").sortWithinPartitions("gram", "lo", "hi").mapInArrow(links(percent, ["gram"]), "a bigint, b bigint"))
    new = written(new.distinct(), "grams-links")
    labels = labels if new.isEmpty() else joined(labels, new)
    return (sketch.select("doc_id", F.col("n").alias("n_shingles")).join(labels, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
