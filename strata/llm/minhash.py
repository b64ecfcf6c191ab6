"""Near-duplicate groups by one-permutation MinHash.

1. *Sketch*: one hash of each distinct shingle; its leading bits choose a bin,
   the bin keeps the smallest rest. Empty bins copy a bin that isn't, found by a
   fixed pseudo-random walk of their own (optimal densification). Consecutive
   bins make the bands.
2. Texts with the same words fold into one representative.
3. Documents with an equal band share a bucket. A bucket gives the edges of two
   stars, from its smallest and its largest id to all others, and edges between
   neighbours in the order of further bins, which puts similar documents side by
   side: at most four times as many edges as members, however large the bucket.
   An edge goes where sizes and bitmaps of its two sets rule a link out: the bits in
   which two bitmaps differ are a lower bound of the shingles that only one text has.
4. The edges of the first star are confirmed on the full shingle sets of both whole
   texts; then those of the other edges whose ends these links don't join.
5. Smallest reachable id by label propagation with pointer jumping; every round
   is written to the shared folder. Later links join the components found so far.
6. Buckets whose members don't all share a component yet are compared whole: each falls into blocks of members, each two blocks
   meet in one task, and a member goes on, with its set, if sizes and bitmaps allow a pair with a member of another
   component. In the task that holds two blocks with their sets, the pairs of different components are confirmed on the full sets,
   and only links that join two components come out. So each pair that shares a bucket is joined by links, ruled
   out by a bound, or confirmed, and rows grow with members, not with pairs.

Defined results: words are the runs of characters other than ASCII white space, A-Z in lower
case; a text with fewer words than a shingle is one shingle of all its words; null
text or text without words has no shingles and links with nothing. Rows of one id
count as one document. A null id links with nothing; its row is kept with a null
component. Other columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, prepare, text_blocks, written
from .linking import block_count, grouped, in_blocks, links

_RNG = np.random.default_rng(20240404)
_BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
CHUNK = 1 << 20
TAILS = 4
#: Cells of the arrays that compare two blocks at a time.
CELLS = 1 << 18
#: 64-bit words of the bitmap of a shingle set.
BITMAP = 8
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK + 1, n)
    if size not in _powers:
        made = []
        for base in (_BASE, _BASE_INVERSE):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        if size > CHUNK + 1:
            return made[0], made[1]
        _powers[size] = (made[0], made[1])
    return _powers[size]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each word of lower-cased bytes."""
    out, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        raw = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
        space = _SPACE[raw]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _power(len(raw) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[raw] * up[:len(raw)], dtype=np.uint64)])
        out.append(mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text."""
    words = word_hashes(text.encode("utf-8", "replace").lower())
    if not len(words):
        return words
    if len(words) < size:
        return mix64(np.array([(words * _PLACES[:len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))]))
    n = len(words) - size + 1
    total = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        total += words[k:k + n] * _PLACES[k]
    return np.unique(mix64(total))


def bitmap(sets: np.ndarray) -> np.ndarray:
    """A bit for each residue that some hash has."""
    bits = np.zeros(64 * BITMAP, dtype=np.uint8)
    bits[(sets % np.uint64(64 * BITMAP)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


class Sketcher:
    """Band keys of shingle sets."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        bits = self.bins.bit_length() - 1
        if 1 << bits != self.bins:
            raise ValueError("bands * rows must be a power of two")
        self.edges = np.arange(self.bins, dtype=np.uint64) << np.uint64(64 - bits)
        walk = np.random.default_rng(20240405)
        self.walk = walk.integers(0, self.bins, (16 * self.bins, self.bins))
        self.tail_bins = walk.permutation(self.bins)[:8 * TAILS].reshape(TAILS, 8)
        self.numbers = (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)

    def __call__(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys, and per tail a number whose order is that of eight bins (a byte of each).

        sets: sorted hashes, at least one."""
        first = np.searchsorted(sets, self.edges)
        full = np.diff(np.append(first, len(sets))) > 0
        source = np.arange(self.bins)
        empty = np.flatnonzero(~full)
        for lo, hi in ((0, 16), (16, 256), (256, len(self.walk))):
            if len(empty):
                hits = full[self.walk[lo:hi, empty]]
                step, found = hits.argmax(axis=0), hits.any(axis=0)
                source[empty[found]] = self.walk[lo + step[found], empty[found]]
                empty = empty[~found]
        source[empty] = np.flatnonzero(full)[0]
        bins = sets[first[source]]
        values = bins.reshape(self.bands, self.rows)
        tails = (mix64(bins[self.tail_bins]) >> np.uint64(56)).astype(np.uint8).view(">u8")[:, 0]
        return mix64((values * _PLACES[:self.rows]).sum(axis=1, dtype=np.uint64) + self.numbers), tails.astype(np.uint64)


SKETCH = "doc_id bigint, n_shingles bigint, words binary, bands array<bigint>, tails array<bigint>, bits array<bigint>"


def _sketch(size, bands, rows):
    def sketch(batches):
        made = Sketcher(bands, rows)
        for batch, texts in text_blocks(batches):
            counts, names, keys, tails, bits = [], [], [], [], []
            for t in texts:
                s = shingles(t, size)
                counts.append(len(s))
                names.append(hashlib.sha256(b" ".join(t.encode("utf-8", "replace").lower().split())).digest()[:16] if len(s) else None)
                k, tail = made(s) if len(s) else (None, None)
                keys.append(None if k is None else k.view(np.int64))
                tails.append(None if k is None else tail.view(np.int64))
                bits.append(None if k is None else bitmap(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(tails, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=[c.split()[0] for c in SKETCH.split(", ")])
    return sketch


def _confirm(size, percent):
    def confirm(batches):
        center, known = None, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")]
            good = []
            for a, b, ta, tb in zip(*cols):
                if center != (a, ta):  # rows come in order of a
                    center, known = (a, ta), shingles(ta, size)
                other = shingles(tb, size)
                both = len(np.intersect1d(known, other, assume_unique=True))
                if both and 100 * both >= percent * (len(known) + len(other) - both):
                    good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int64())],
                                             names=["a", "b"])
    return confirm


def confirmed(edges: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The rows of ``edges`` (a, b) whose full shingle sets are similar. texts: doc_id, text."""
    left, right = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")).join(edges.select(c).distinct(), c, "left_semi")
                   for c in ("a", "b"))
    return (edges.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "text_a", "text_b")
            .mapInArrow(_confirm(size, percent), "a bigint, b bigint").distinct())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """doc_id, component_id (the smallest id reachable over ``edges`` (a, b)) for every id in an edge."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct()
    both = written(both, f"{name}-edges")
    now = written(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("label")), name)
    while True:
        seen = now.select(F.col("u").alias("v"), F.col("label").alias("other"))
        near = written(both.join(seen, "v").groupBy("u").agg(F.min("other").alias("near")), f"{name}-near")
        lower = now.join(near, "u").select("u", "label", F.least("label", "near").alias("low"))
        # the label of the label: halves the way to the smallest id
        jump = now.select(F.col("u").alias("low"), F.col("label").alias("jump"))
        after = written(lower.join(jump, "low", "left").select(
            "u", F.least("low", F.coalesce("jump", "low")).alias("label"),
            (F.least("low", F.coalesce("jump", "low")) < F.col("label")).alias("moved")), name)
        now = after.select("u", "label")
        if after.where("moved").isEmpty():
            return now.select(F.col("u").alias("doc_id"), F.col("label").alias("component_id"))


def _neighbours(percent):
    """Edges between rows of one key that follow each other directly or with one row between, if they may link."""
    def neighbours(batches):
        rows = [np.zeros(0, np.int64)] * 3 + [np.zeros((0, BITMAP), np.int64)]
        for batch in batches:
            new = [batch.column(c).to_numpy() for c in ("key", "doc_id", "size")]
            new.append(batch.column("bits").flatten().to_numpy().reshape(-1, BITMAP))
            rows = [np.concatenate([x, y]) for x, y in zip(rows, new)]
            key, doc, size, bits = rows
            old = len(key) - batch.num_rows
            for step in (1, 2):
                lo = max(old - step, 0)  # pairs of rows before have been given
                one, two = slice(lo, -step), slice(lo + step, None)
                apart = np.maximum(np.bitwise_count(bits[one] ^ bits[two]).sum(axis=1, dtype=np.int64), np.abs(size[one] - size[two]))
                edge = (key[one] == key[two]) & (doc[one] != doc[two]) & ((size[one] + size[two]) * (100 - percent) >= apart * (100 + percent))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[one], doc[two])[edge]), pa.array(np.maximum(doc[one], doc[two])[edge])],
                                                 names=["a", "b"])
            rows = [x[-2:] for x in rows]
    return neighbours


def star(rows: DataFrame, center: str, percent: int) -> DataFrame:
    """Edges a < b from the documents in column ``center`` to those of the rows, if they may link."""
    c = F.col(center)
    bits = F.aggregate(F.zip_with("bits", c["bits"], lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    apart = F.greatest(bits.cast("bigint"), F.abs(F.col("size") - c["size"]))
    near = (F.col("size") + c["size"]) * (100 - percent) >= apart * (100 + percent)
    return rows.where((F.col("doc_id") != c["doc_id"]) & F.coalesce(near, F.lit(True))).select(
        F.least(c["doc_id"], "doc_id").alias("a"), F.greatest(c["doc_id"], "doc_id").alias("b"))


def candidates(members: DataFrame, percent: int) -> DataFrame:
    """Further distinct edges of the buckets' members (key, doc_id, size, bits, tail, low, high): a star from the largest
    id, and neighbours by tail."""
    lines = members.where("size is not null").select("key", "tail", "doc_id", "size", "bits").repartitionByRange("key", "tail", "doc_id")
    chain = (lines.sortWithinPartitions("key", "tail", "doc_id").select("key", "doc_id", "size", "bits")
             .mapInArrow(_neighbours(percent), "a bigint, b bigint"))
    return star(members, "high", percent).union(chain).distinct()


def _ends(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``edges`` with the components of both ends (label_a, label_b); an id that has none is its own."""
    for c in ("a", "b"):
        known = labels.select(F.col("doc_id").alias(c), F.col("component_id").alias("_label"))
        edges = edges.join(known, c, "left").withColumn(f"label_{c}", F.coalesce("_label", c)).drop("_label")
    return edges


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (doc_id, component_id) after more ``links`` (a, b): only the components that these touch are walked."""
    ends = _ends(links, labels).select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).where("a < b")
    roots = components(ends, "near-roots").select(F.col("doc_id").alias("component_id"), F.col("component_id").alias("root"))
    new = links.select(F.col("a").alias("doc_id")).union(links.select("b"))
    known = labels.union(new.select("doc_id", "doc_id")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return written(known.join(roots, "component_id", "left").select("doc_id", F.coalesce("root", "component_id").alias("component_id")), "near-labels")


def _undecided(percent):
    """Rows (key, lo, hi, block, doc_id, label, size, bits) in order of the group -> the members of a pair of components that may link."""
    def run(batches):
        for group in grouped(batches, ["key", "lo", "hi"]):
            lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
            block, label, size = (group.column(c).to_numpy() for c in ("block", "label", "size"))
            bits = group.column("bits").combine_chunks().flatten().to_numpy().reshape(-1, BITMAP)
            left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            keep = np.zeros(len(block), dtype=bool)
            step = max(1, CELLS // max(1, len(right)))
            for at in range(0, len(left), step):
                one = left[at:at + step]
                near = label[one][:, None] != label[right][None, :]
                if not near.any():
                    continue
                apart = np.abs(size[one][:, None] - size[right][None, :])
                both = np.zeros(apart.shape, dtype=np.int64)
                for k in range(BITMAP):
                    both += np.bitwise_count(bits[one, k][:, None] ^ bits[right, k][None, :])
                fits = (size[one][:, None] + size[right][None, :]) * (100 - percent) >= np.maximum(apart, both) * (100 + percent)
                fits |= (size[one] < 0)[:, None] | (size[right] < 0)[None, :]  # an id of several texts: nothing is ruled out
                near &= fits
                keep[one] |= near.any(axis=1)
                keep[right] |= near.any(axis=0)
            if keep.any():
                yield from group.select(["key", "lo", "hi", "block", "doc_id", "label"]).filter(pa.array(keep)).to_batches()
    return run


def undecided(members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Of the buckets that hold several components, the members of pairs of different components that sizes and bitmaps allow: a row for
    each two blocks of a bucket that have such a pair."""
    rows = members.select("key", "doc_id", "size", "bits").join(labels.withColumnRenamed("component_id", "label"), "doc_id", "left")
    rows = rows.withColumn("label", F.coalesce("label", "doc_id"))
    several = (rows.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("m"), F.sum("size").alias("total"))
               .where("l0 < l1").select("key", block_count(F.col("m"), F.coalesce("total", "m")).alias("blocks")))
    rows = in_blocks(rows.join(several, "key"), F.col("blocks"), "doc_id").select(
        "key", "lo", "hi", "block", "doc_id", "label", F.coalesce("size", F.lit(-1)).alias("size"),
        F.coalesce("bits", F.array_repeat(F.lit(0).cast("bigint"), BITMAP)).alias("bits"))
    return (rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
            .mapInArrow(_undecided(percent), "key bigint, lo int, hi int, block int, doc_id bigint, label bigint"))


def _sets(size):
    def sets(batches):
        for batch, texts in text_blocks(batches):
            made = [shingles(t, size) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())],
                                             names=["doc_id", "size", "shingles"])
    return sets


def groups(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Documents link if 100 * shared shingles >= percent * shingles of either. The chance that a pair at 80 % shares
    no band is (1 - 0.8 ** rows) ** bands, about 5e-8 by default.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketch = written(docs.mapInArrow(_sketch(size, bands, rows), SKETCH), "near-sketch")
    ids = sketch.where("doc_id is not null and words is not null")
    folded = written(ids.groupBy("words").agg(F.min("doc_id").alias("rep")), "near-folded")
    # ids whose texts hold the same words as a smaller id's
    same = written(ids.select("doc_id", "words").join(folded, "words").where("doc_id <> rep")
                   .select(F.col("rep").alias("a"), F.col("doc_id").alias("b")), "near-same")
    # one row for each distinct text
    reps = ids.join(folded.select(F.col("rep").alias("doc_id"), "words"), ["doc_id", "words"], "left_semi")
    buckets = written(reps.select(F.explode("bands").alias("key"), "doc_id"), "near-buckets")
    shared = written(buckets.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
                     .where("low < high").select("key"), "near-shared")
    members = written(buckets.join(shared, "key"), "near-members")
    one = F.count(F.lit(1)) == 1  # an id of several texts has no size and bitmap, which rules nothing out
    marks = (reps.join(members.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id")
             .agg(F.when(one, F.min("n_shingles")).alias("size"), F.when(one, F.first("bits")).alias("bits"), F.first("tails").alias("tails")))
    tail = F.element_at("tails", (F.pmod("key", F.lit(TAILS)) + 1).cast("int")).alias("tail")
    members = written(members.join(marks, "doc_id").select("key", "doc_id", "size", "bits", tail), "near-marked")
    me = F.struct("doc_id", "size", "bits")
    centers = written(members.groupBy("key").agg(F.min_by(me, "doc_id").alias("low"), F.max_by(me, "doc_id").alias("high")), "near-centers")
    members = written(members.join(centers, "key"), "near-members")
    tested = written(star(members, "low", percent).distinct(), "near-edges")
    texts = written(docs.where("text is not null").join(written(members.select("doc_id").distinct(), "near-ends"), "doc_id", "left_semi"), "near-texts")
    labels = components(written(confirmed(tested, texts, size, percent), "near-links").union(same))
    apart = _ends(candidates(members, percent).join(tested, ["a", "b"], "left_anti"), labels).where("label_a <> label_b")
    new = written(confirmed(written(apart.select("a", "b"), "near-edges"), texts, size, percent), "near-links")
    labels = labels if new.isEmpty() else joined(labels, new)
    left = written(undecided(members, labels, percent), "near-open")
    sets = texts.join(left.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_sets(size), "doc_id bigint, size bigint, shingles binary")
    left = left.join(sets.where("size > 0"), "doc_id").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    new = written(left.mapInArrow(links(percent, ["key"]), "a bigint, b bigint").distinct(), "near-links")
    labels = labels if new.isEmpty() else joined(labels, new)
    return (sketch.select("doc_id", "n_shingles").join(labels, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                    F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept")))
