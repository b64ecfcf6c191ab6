"""Byte-level BPE encoding and decoding over a hierarchical-bitmap rank queue.

The bytes of pre-tokens form linked lists. Every adjacent pair that merges stands
in the bucket of its merge rank, as the place of its left part. A bitmap over the
ranks, with two levels above it that mark words which aren't zero, gives the
lowest rank in use by three find-first-set steps. The bucket's places are taken
from left to right; entries whose parts have been merged away or have grown are
stale and skipped. Pre-tokens don't touch each other, so those of many texts share
one queue. A merge costs the same however long the pre-token is, so unbroken
runs of bytes are no problem.

Defined results: null text counts as empty and has no ids. Rows are kept as they
come. Encoding keeps the other columns; a column of a result's name is replaced.
Decoding an unknown id is an error; null ids decode to null.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare, text_blocks
from .pieces import BYTE_LEVEL, PieceEncoder

#: How ids are stored.
IDS = "<u4"


class RankQueue:
    """Places by rank; the lowest rank first."""

    def __init__(self, ranks: int):
        self.buckets: list[array | None] = [None] * ranks
        self.words = [0] * (ranks // 64 + 1)             # a bit per rank
        self.blocks = [0] * (len(self.words) // 64 + 1)  # a bit per word
        self.top = 0                                     # a bit per block

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets[rank]
        if bucket is None:
            bucket = self.buckets[rank] = array("i")
            w = rank >> 6
            self.words[w] |= 1 << (rank & 63)
            self.blocks[w >> 6] |= 1 << (w & 63)
            self.top |= 1 << (w >> 6)
        bucket.append(place)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its places in ascending order; its bucket is empty then."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        w = (b << 6) + (self.blocks[b] & -self.blocks[b]).bit_length() - 1
        rank = (w << 6) + (self.words[w] & -self.words[w]).bit_length() - 1
        places, self.buckets[rank] = sorted(self.buckets[rank]), None
        self.words[w] &= self.words[w] - 1
        if not self.words[w]:
            self.blocks[b] &= self.blocks[b] - 1
            if not self.blocks[b]:
                self.top &= self.top - 1
        return rank, places


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        if pattern != BYTE_LEVEL:
            raise ValueError("only the byte-level split pattern is known to allow cutting texts into pieces")
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.texts = PieceEncoder(lambda new: [np.array(x, dtype=IDS).tobytes() for x in self.merge([t.encode("utf-8", "replace") for t in new])],
                                  regex.compile(pattern).findall)

    @classmethod
    @lru_cache(maxsize=1)
    def from_file(cls, data: bytes, pattern: str) -> Codec:
        """data: lines of a base64 token and its rank. One codec per worker process."""
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}, pattern)

    def merge(self, pretokens: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token."""
        out: list[list[int] | None] = [None if (r := self.ranks.get(p)) is None else [r] for p in pretokens]
        rest = [i for i, x in enumerate(out) if x is None]
        lo = 0
        while lo < len(rest):  # the lists in use at a time are bounded, but for one long pre-token
            hi, size = lo, 0
            while hi < len(rest) and (hi == lo or size + len(pretokens[rest[hi]]) <= 1 << 20):
                size += len(pretokens[rest[hi]])
                hi += 1
            for i, ids in zip(rest[lo:hi], self._merge([pretokens[i] for i in rest[lo:hi]])):
                out[i] = ids
            lo = hi
        return out

    def _merge(self, pretokens: list[bytes]) -> list[list[int]]:
        data = b"".join(pretokens)
        get, queue, push, n = self.ranks.get, self.queue, self.queue.push, len(data)
        begins = bytearray(n + 1)  # 1 where a pre-token begins, and at the end
        at = 0
        for p in pretokens:
            begins[at] = 1
            at += len(p)
        begins[n] = 1
        after = array("i", range(1, n + 1))  # where the next part begins; 0 if the part is gone
        before = array("i", range(-1, n))    # where the previous part begins
        for i in range(n - 1):
            if not begins[i + 1]:
                r = get(data[i:i + 2])
                if r is not None:
                    push(r, i)
        while (top := queue.pop()) is not None:
            rank, places = top
            for turn, i in enumerate(places):
                j = after[i]
                if not j or begins[j]:
                    continue  # stale: the part at i is gone, or the last
                k = after[j]
                if get(data[i:k]) != rank:
                    continue  # stale: one of the parts has grown
                after[i], after[j] = k, 0
                lower = False
                if not begins[k]:
                    before[k] = i
                    r = get(data[i:after[k]])
                    if r is not None:
                        push(r, i)
                        lower = r < rank
                if not begins[i]:
                    h = before[i]
                    r = get(data[h:k])
                    if r is not None:
                        push(r, h)
                        lower = lower or r < rank
                if lower:  # a lower rank came up: it goes first
                    for later in places[turn + 1:]:
                        push(rank, later)
                    break
        out, i = [], 0
        for p in pretokens:
            end, ids = i + len(p), []
            while i < end:
                ids.append(get(data[i:after[i]]))
                i = after[i]
            out.append(ids)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def _replaced(batch: pa.RecordBatch, cols: dict[str, pa.Array]) -> pa.RecordBatch:
    for name in cols:
        i = batch.schema.get_field_index(name)
        if i >= 0:
            batch = batch.remove_column(i)
    for name, col in cols.items():
        batch = batch.append_column(name, col)
    return batch


def _fields(df: DataFrame, without: set[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name not in without)


def _shared(df: DataFrame, vocabulary: str):
    """The vocabulary's file: read once, bounded by the vocabulary."""
    prepare(df.sparkSession)
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``df`` with ``ids`` (binary, little-endian 32-bit ids of ``text``) and ``n_tokens``."""
    shared = _shared(df, vocabulary)

    def run(batches):
        codec = Codec.from_file(shared.value, pattern)
        for batch, texts in text_blocks(batches):
            ids = codec.texts(texts)
            yield _replaced(batch, {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())})
    return df.mapInArrow(run, f"{_fields(df, {'ids', 'n_tokens'})}ids binary, n_tokens bigint")


def decode(df: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``df`` with ``decoded``: the bytes that ``ids`` stand for."""
    shared = _shared(df, vocabulary)

    def run(batches):
        codec = Codec.from_file(shared.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                data = [None if x is None else codec.decode(np.frombuffer(x, dtype=IDS)) for x in part.column("ids").to_pylist()]
                yield _replaced(part, {"decoded": pa.array(data, pa.binary())})
    return df.mapInArrow(run, f"{_fields(df, {'decoded'})}decoded binary")


def digests(df: DataFrame, vocabulary: str, pattern: str, keep: list[str]) -> DataFrame:
    """Columns ``keep``, and per text: n_tokens, ids_sha256 of its ids in decimal, joined by commas, and
    decoded_sha256 of what those ids decode to. Encodes and decodes in one pass, so ids travel nowhere."""
    shared = _shared(df, vocabulary)
    rows = df.select(*[c for c in keep], "text") if "text" not in keep else df.select(*keep)

    def run(batches):
        codec = Codec.from_file(shared.value, pattern)
        decimal = {i: str(i) for i in codec.tokens}
        for batch, texts in text_blocks(batches):
            n, said, back = [], [], []
            for data in codec.texts(texts):
                ids = np.frombuffer(data, dtype=IDS)
                n.append(len(ids))
                said.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield _replaced(batch.select(keep), {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(said, pa.string()),
                                                 "decoded_sha256": pa.array(back, pa.string())})
    new = {"n_tokens", "ids_sha256", "decoded_sha256"}
    return rows.mapInArrow(run, f"{_fields(rows.select(*keep), new)}n_tokens bigint, ids_sha256 string, decoded_sha256 string")
