"""Alignment of two tokenizations of the same texts, and the corpus-wide counts of the ids that they link.

Interval coalescing: every token of A and B is an interval of bytes. All intervals are lexsorted by start; the running
maximum of the ends (``maximum.accumulate``) tells how far the intervals so far reach, and a group ends where a start reaches
it. Within a group, the B tokens that overlap an A token are a range found by binary search, and are expanded to pairs.
All texts of a slice (about 256 thousand characters) are coalesced at once, laid one behind the other. Overlapping pairs whose
ends are equal are *links*.

Counts: the documents of a block (some slices) name their links by the places of the block's distinct id pairs. Only these
pairs and their numbers go into the count, which is a partial and a final aggregation, and come back to the block by a join; so the
rows that are shuffled are distinct pairs per block and documents, never token occurrences, and nothing is broadcast
but the two vocabularies.

B is encoded by segments: if no piece of its vocabulary goes on behind a word, a text whose spaces are single and inside
can be cut before each, and each worker process remembers recent segments, up to a bound that holds for A's too. Other texts are encoded whole.

Defined results: a text that is null or empty, or whose tokens of A or of B don't give back the bytes of space and text, has no
tokens: zeros, and an empty alignment. Every row gives a row, repeated rows too. Only doc_id and text are read.
An empty table gives an empty result. A text is worked on whole, in one task.
"""

from __future__ import annotations

import hashlib
import json
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_blocks, written
from .pieces import Recent
from .token_files import byte_characters, library_encoder

#: Characters of a slice, and slices whose distinct pairs are counted together.
SLICE_CHARS, BLOCK_SLICES = 1 << 18, 16
#: A worker remembers so many recent segments of A and of B, twice as many at most. It keeps them while it serves later stages.
SEGMENTS_A, SEGMENTS_B = 300_000, 100_000
#: Places in a block of so many pairs fit two bytes.
SHORT = 1 << 16
SPACE = "▁"


class ByteLevel:
    """A: a byte-level vocabulary of the tokenizers library."""

    WIDTH = 4

    def __init__(self, data: bytes, limit: int):
        spelled = json.loads(data)
        of_char = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = spelled["model"]["vocab"] | {t["content"]: t["id"] for t in spelled.get("added_tokens", [])}
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
        self.library = library_encoder(data, self.WIDTH, limit)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, dtype="<u4") for x in self.library([" " + t for t in texts])]


class Pieces:
    """B: a sentencepiece vocabulary, whose library adds the first space itself."""

    def __init__(self, data: bytes, limit: int):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.tokens = [b"" if self.model.is_control(i) or self.model.is_unknown(i) else bytes([int(p[3:5], 16)]) if self.model.is_byte(i)
                       else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.cuttable = not any(SPACE in p.lstrip(SPACE) for p in names)
        self.recent = Recent(limit)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [t.split(" ") if self.cuttable and t[:1] != " " and t[-1:] != " " and "  " not in t else None for t in texts]
        get, old = self.recent.young.get, self.recent.old.get
        found = [None if c is None else list(map(get, c)) for c in cut]
        holes = [(c, f, [i for i, v in enumerate(f) if v is None]) for c, f in zip(cut, found) if c and None in f]
        missed = {c[i] for c, _, miss in holes for i in miss}
        learnt = {s: v for s in missed if (v := old(s)) is not None}
        new = [s for s in missed if s not in learnt]
        whole = [t for t, c in zip(texts, cut) if c is None]
        made = [struct.pack(f"<{len(x)}I", *x) for x in self.model.encode(new + whole, num_threads=1)] if new or whole else []
        learnt.update(zip(new, made))
        rest = iter(made[len(new):])
        self.recent.keep(learnt)
        for c, f, miss in holes:
            for i in miss:
                f[i] = learnt[c[i]]
        out = [next(rest) if f is None else b"".join(f) for f in found]
        return [np.frombuffer(x, dtype="<u4") for x in out]


def coalesce(starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the intervals by start (then kind), and the number of the group of each, in that order."""
    order = np.lexsort((ends, kinds, starts))
    reach = np.maximum.accumulate(ends[order])
    begins = np.zeros(len(order), dtype=np.int64)
    begins[1:] = starts[order][1:] >= reach[:-1]
    return order, np.cumsum(begins)


def overlaps(a_starts, a_ends, b_starts, b_ends) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and B of all pairs that share a byte. Both come in order and don't overlap among themselves."""
    first = np.searchsorted(b_ends, a_starts, side="right")
    n = np.searchsorted(b_starts, a_ends, side="left") - first
    a = np.repeat(np.arange(len(a_starts)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Aligner:
    """Aligns slices of texts. One per worker process."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteLevel(a, SEGMENTS_A), Pieces(b, SEGMENTS_B)
        self.lengths = [np.array([len(t) for t in x.tokens], dtype=np.int64) for x in (self.a, self.b)]
        self.size = max(len(self.a.tokens), len(self.b.tokens))
        # the decimal ids with what may follow them
        self.spelled = [f"{i}{sep}" for sep in (",", "|", ";", "") for i in range(self.size)]

    @classmethod
    @lru_cache(maxsize=1)
    def of(cls, a: bytes, b: bytes) -> Aligner:
        return cls(a, b)

    def __call__(self, texts: list[str]) -> Slice:
        """Null texts come as empty ones."""
        full = [t for t in texts if t]
        ids = [iter(x.encode(full)) if full else iter(()) for x in (self.a, self.b)]
        none, kept = np.zeros(0, dtype="<u4"), []
        for t in texts:
            both = [next(ids[0]), next(ids[1])] if t else [none, none]
            data = b" " + t.encode("utf-8", "replace") if t else b""
            if any(b"".join(map(x.tokens.__getitem__, i.tolist())) != data for x, i in zip((self.a, self.b), both)):
                both = [none, none]
            kept.append(both)
        return Slice(self, kept)


class Slice:
    """Texts laid one behind the other: tokens, groups and overlapping pairs.

    ids, starts, ends: of the tokens of A and of B; first: where each text's tokens of A and of B begin, and the end."""

    def __init__(self, of: Aligner, kept: list[list[np.ndarray]]):
        self.of, self.n = of, len(kept)
        self.ids = [np.concatenate([k[x] for k in kept]).astype(np.int64) if kept else np.zeros(0, np.int64) for x in (0, 1)]
        self.first = [np.concatenate([[0], np.cumsum([len(k[x]) for k in kept])]).astype(np.int64) for x in (0, 1)]
        size = [of.lengths[x][self.ids[x]] for x in (0, 1)]
        self.ends = [np.cumsum(s) for s in size]  # tokens of a text cover it whole, so both lay the texts alike
        self.starts = [e - s for e, s in zip(self.ends, size)]
        kinds = np.repeat([0, 1], [len(self.ids[0]), len(self.ids[1])])
        order, number = coalesce(np.concatenate(self.starts), np.concatenate(self.ends), kinds)
        group = np.zeros(len(order), dtype=np.int64)
        group[order] = number
        self.group = [group[:len(self.ids[0])], group[len(self.ids[0]):]]
        self.a, self.b = overlaps(self.starts[0], self.ends[0], self.starts[1], self.ends[1])

    def per_text(self, x: int, places: np.ndarray) -> np.ndarray:
        """How many ascending places of tokens of A (0) or B (1) stand before each text's first token, and in all."""
        return np.searchsorted(places, self.first[x])

    def n_groups(self) -> np.ndarray:
        begins = np.flatnonzero(np.diff(self.group[0], prepend=-1))
        return np.diff(self.per_text(0, begins))

    def links(self) -> list[np.ndarray]:
        """Per text the id pairs (id of A shifted by 32 bits, plus id of B) of overlapping tokens that end together."""
        together = self.ends[0][self.a] == self.ends[1][self.b]
        a, b = self.a[together], self.b[together]
        codes, cuts = (self.ids[0][a] << 32) + self.ids[1][b], self.per_text(0, a)
        return [codes[x:y] for x, y in zip(cuts[:-1], cuts[1:])]

    def groups(self) -> list[str]:
        """Per text its groups as ``a1,a2|b1;a3|b2,b3``."""
        ids, group = np.concatenate(self.ids), np.concatenate(self.group)
        kind = np.repeat([0, 1], [len(x) for x in self.ids])
        order = np.lexsort((kind, group))  # stable: tokens of one kind stay in order
        group, kind = group[order], kind[order]
        last = self.first[0] + self.first[1]
        sep = np.zeros(len(order), dtype=np.int64)
        sep[:-1] = np.where(group[1:] != group[:-1], 2, np.where(kind[1:] != kind[:-1], 1, 0))
        sep[last[1:][last[1:] > 0] - 1] = 3
        spelled = list(map(self.of.spelled.__getitem__, (sep * self.of.size + ids[order]).tolist()))
        return ["".join(spelled[x:y]) for x, y in zip(last[:-1].tolist(), last[1:].tolist())]

    def spans(self) -> list[list[dict]]:
        """Per text its groups: bytes from, to (of space and text) and the ids of both sides."""
        out = []
        for t in range(self.n):
            (a0, b0), (a1, b1) = (self.first[0][t], self.first[1][t]), (self.first[0][t + 1], self.first[1][t + 1])
            numbers = np.unique(self.group[0][a0:a1])
            a_cuts, b_cuts = (np.append(np.searchsorted(self.group[x][f:l], numbers), l - f) + f for x, f, l in ((0, a0, a1), (1, b0, b1)))
            base = self.starts[0][a0] if a1 > a0 else 0
            out.append([{"from": int(self.starts[0][a] - base), "to": int(self.ends[0][a2 - 1] - base), "a": self.ids[0][a:a2].tolist(),
                         "b": self.ids[1][b:b2].tolist()} for a, a2, b, b2 in zip(a_cuts[:-1], a_cuts[1:], b_cuts[:-1], b_cuts[1:])])
        return out


def _shared(docs: DataFrame, vocabulary_a: str, vocabulary_b: str):
    """The two vocabularies' files: read once, bounded by the vocabularies."""
    prepare(docs.sparkSession)
    data = []
    for name in (vocabulary_a, vocabulary_b):
        with open(name, "rb") as f:
            data.append(f.read())
    return docs.sparkSession.sparkContext.broadcast(tuple(data))


SPANS = "doc_id bigint, groups array<struct<from: bigint, to: bigint, a: array<bigint>, b: array<bigint>>>"


def align(docs: DataFrame, vocabulary_a: str, vocabulary_b: str) -> DataFrame:
    """doc_id and the groups of each text: their bytes, and the ids of both sides."""
    shared = _shared(docs, vocabulary_a, vocabulary_b)

    def run(batches):
        aligner = Aligner.of(*shared.value)
        ids = pa.list_(pa.int64())
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("a", ids), ("b", ids)]))
        for batch, texts in text_blocks(batches, SLICE_CHARS):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(aligner(texts).spans(), kind)], names=["doc_id", "groups"])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SPANS)


#: kind 1: the distinct pairs of a block and how many links hold each; kind 2: a document, whose links name the block's pairs by place.
BLOCKS = ("block bigint, kind int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary, "
          "pairs array<bigint>, counts array<bigint>")


def _places(pairs: int) -> str:
    """The type of places in a block of so many pairs."""
    return "<u2" if pairs <= SHORT else "<u4"


def _blocks(shared):
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def blocks(batches):
        aligner, number = Aligner.of(*shared.value), TaskContext.get().partitionId() << 32
        held, links, slices = [], [], 0

        def close():
            pairs, place, counts = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
            cuts = np.cumsum([len(x) for x in links])[:-1]
            named = [x.tobytes() for x in np.split(place.astype(_places(len(pairs))), cuts)]
            rows = [(number, 1, None, None, None, None, None, None, pairs, counts)]
            rows += [(number, 2, *row, said, None, None) for row, said in zip(held, named)]
            for lo in range(0, len(rows), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo:lo + 500]), kinds)], names=names)

        for batch, texts in text_blocks(batches, SLICE_CHARS):
            made = aligner(texts)
            groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in made.groups()]
            held += zip(batch.column("doc_id").to_pylist(), np.diff(made.first[0]).tolist(), np.diff(made.first[1]).tolist(), made.n_groups().tolist(), groups)
            links += made.links()
            slices += 1
            if slices == BLOCK_SLICES:
                yield from close()
                held, links, slices, number = [], [], 0, number + 1
        if held:
            yield from close()
    return blocks


RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _scores(batches):
    """Rows in order of block, kind, place: a block's pairs with their counts come before its documents."""
    block, totals, best = None, [], []
    for batch in batches:
        blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for lo, hi in zip([0, *edges], [*edges, len(blocks)]):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            if blocks[lo] != block:
                block, totals, best = blocks[lo], [], []
            if kinds[lo] == 1:
                totals.append(part.column("total").to_numpy(zero_copy_only=False))
                best.append(part.column("best").to_numpy(zero_copy_only=False))
                continue
            totals, best = ([np.concatenate(x)] if x else [np.zeros(0, np.int64)] for x in (totals, best))
            named = [np.frombuffer(x, dtype=_places(len(totals[0]))) for x in part.column("links").to_pylist()]
            more = {"n_links": [len(x) for x in named], "n_best": [int(best[0][x].sum()) for x in named], "count_sum": [int(totals[0][x].sum()) for x in named]}
            cols = [c.split()[0] for c in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(more[c], pa.int64()) if c in more else part.column(c) for c in cols], names=cols)


def link_counts(docs: DataFrame, vocabulary_a: str, vocabulary_b: str) -> DataFrame:
    """Per document: tokens of both sides, groups, links; n_best: links whose id pair is the most frequent one of its id of B in the whole
    corpus, ties included; count_sum: the corpus-wide counts of its links' pairs, summed; and a digest of the groups."""
    shared = _shared(docs, vocabulary_a, vocabulary_b)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_blocks(shared), BLOCKS)
    rows = written(rows, "aligned")
    pairs = rows.where("kind = 1").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x"))
    pairs = pairs.select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    totals = written(pairs.groupBy("pair").agg(F.sum("n").alias("total")), "pair-totals")
    of_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = totals.groupBy(of_b.alias("of_b")).agg(F.max("total").alias("most"))
    totals = totals.withColumn("of_b", of_b).join(most, "of_b").select("pair", "total", (F.col("total") == F.col("most")).cast("bigint").alias("best"))
    known = pairs.join(totals, "pair").select("block", F.lit(1).alias("kind"), F.col("place").cast("bigint").alias("place"), "total", "best")
    documents = rows.where("kind = 2").drop("pairs", "counts")
    return (known.unionByName(documents, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind", "place")
            .mapInArrow(_scores, RESULT))
