"""Token ids in binary shards with a minimal perfect hash index.

A shard is two files. ``shard-N.ids``: 16 bytes of header (magic, version, bytes
per id, end id), then nothing but little-endian ids. ``shard-N.idx``: a minimal
perfect hash of the shard's keys (bit arrays of several levels, with ranks), and
per slot a 32-bit fingerprint, the place of the first id and the number of ids.
A lookup costs a few hashes; the fingerprint tells keys that aren't stored.

Documents lie in ascending id order over all shards. Encoding happens before the
one shuffle, which deals documents to shards by id ranges of about equal count.

Defined results: null text counts as empty (only the end id). A null id comes
before all others. Rows with one id follow each other in the order of their ids'
bytes; their keys are (id, 0), (id, 1) and so on. An empty table makes no shard.
Other columns play no part.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import mix64, prepare, text_blocks
from .pieces import BYTE_LEVEL, PieceEncoder

MAGIC = b"STRATAID"
HEADER = struct.Struct("<8sHHI")
#: Bytes of ids that a writer gathers before it writes.
WRITE_BYTES = 1 << 20
NULL_KEY = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- files

def _store(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, write) -> None:
    """Write under another name, then move: readers see whole files only, and a repeated task does no harm."""
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    tmp = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(tmp) as f:
        write(f)
    store.move(tmp, f"{base}/{name}")


# ---------------------------------------------------------------- minimal perfect hash

def key_hash(ids: np.ndarray, nulls: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    """64-bit keys; distinct for distinct ids with ordinal 0."""
    with np.errstate(over="ignore"):
        k = mix64(ids.astype(np.int64).view(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        k = np.where(nulls, NULL_KEY, k)
        return np.where(ordinals > 0, mix64(k + mix64(ordinals.astype(np.uint64))), k)


class PerfectHash:
    """Levels of bit arrays: a key's slot is the rank of the first bit that it alone set when the hash was built."""

    GAMMA, LEVELS = 1.7, 80

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(keys):
            if len(sizes) == cls.LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            size = -(-int(cls.GAMMA * len(keys) + 1) // 64) * 64
            place = (mix64(keys ^ np.uint64(len(sizes) + 1)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys = keys[~alone[place]]
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(words) if words else np.zeros(0, dtype="<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot per key, or -1 (keys that weren't stored may get either)."""
        out = np.full(len(keys), -1, dtype=np.int64)
        rest = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(rest):
                break
            at = (mix64(keys[rest] ^ np.uint64(level + 1)) % np.uint64(size)).astype(np.int64) + self.first[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[rest[hit]] = (self.ranks[at >> 6] + below)[hit]
            rest = rest[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype("<u4")


class ShardWriter:
    """Writes the ids of one shard as they come; only keys and counts stay in memory until the index is written."""

    def __init__(self, folder: str, shard: int, end_id: int, width: int):
        self.folder, self.shard, self.width = folder, shard, width
        self.store, self.base = _store(folder)
        self.store.create_dir(self.base, recursive=True)
        self.tmp = f"{self.base}/.shard-{shard:06d}.ids.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.tmp)
        self.out.write(HEADER.pack(MAGIC, 1, width, end_id))
        self.ids, self.nulls, self.ordinals, self.counts = array("q"), bytearray(), array("q"), array("q")
        self.held = bytearray()

    def add(self, doc_id: int | None, data: bytes) -> None:
        again = len(self.ids) > 0 and self.ids[-1] == (doc_id or 0) and self.nulls[-1] == (doc_id is None)
        self.ordinals.append(self.ordinals[-1] + 1 if again else 0)
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(data) // self.width)
        self.held += data
        if len(self.held) >= WRITE_BYTES:
            self.out.write(bytes(self.held))
            self.held.clear()

    def close(self) -> pa.RecordBatch:
        """Put both files in place; the keys (doc_id, ordinal, shard, n). Readers see whole files only, and a repeated task does no harm."""
        self.out.write(bytes(self.held))
        self.out.close()
        ids, ordinals, counts = (np.frombuffer(x, dtype=np.int64) for x in (self.ids, self.ordinals, self.counts))
        nulls = np.frombuffer(self.nulls, dtype=np.uint8).astype(bool)
        index = shard_index(key_hash(ids, nulls, ordinals), counts)
        self.store.move(self.tmp, f"{self.base}/shard-{self.shard:06d}.ids")
        _put(self.folder, f"shard-{self.shard:06d}.idx", lambda f: f.write(index.getbuffer()))
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(ordinals), pa.array(np.full(len(ids), self.shard, dtype=np.int32)),
                                           pa.array(counts)], names=["doc_id", "ordinal", "shard", "n"])


def shard_index(keys: np.ndarray, counts: np.ndarray) -> io.BytesIO:
    starts = np.cumsum(counts) - counts
    ph = PerfectHash.build(keys)
    slot = ph.slots(keys)
    table = {"sizes": ph.sizes, "words": ph.words}
    for name, col, kind in (("prints", fingerprints(keys), "<u4"), ("starts", starts, "<u8"), ("counts", counts, "<u8")):
        table[name] = np.zeros(len(keys), dtype=kind)
        table[name][slot] = col
    buf = io.BytesIO()
    np.savez(buf, **table)
    return buf


class Shard:
    """Keyed access to one shard."""

    def __init__(self, folder: str, shard: int):
        store, base = _store(folder)
        with store.open_input_stream(f"{base}/shard-{shard:06d}.idx") as f:
            self.index = dict(np.load(io.BytesIO(f.read())))
        self.hash = PerfectHash(self.index["sizes"], self.index["words"])
        self.file = store.open_input_file(f"{base}/shard-{shard:06d}.ids")
        magic, _, self.width, self.end_id = HEADER.unpack(self.file.read(HEADER.size))
        if magic != MAGIC:
            raise ValueError(f"shard {shard} is no id file")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is stored, the place of its first id in the shard, and the number of its ids."""
        slot = self.hash.slots(keys)
        if not len(self.index["prints"]):
            return slot >= 0, slot, slot
        at = np.maximum(slot, 0)
        known = (slot >= 0) & (self.index["prints"][at] == fingerprints(keys))
        return known, self.index["starts"][at].astype(np.int64), self.index["counts"][at].astype(np.int64)

    def ids(self, start: int, count: int) -> np.ndarray:
        self.file.seek(HEADER.size + start * self.width)
        return np.frombuffer(self.file.read(count * self.width), dtype=f"<u{self.width}")


# ---------------------------------------------------------------- Spark

def byte_characters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself if it's visible, else one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return "".join(chr(b if b in visible else 0x100 + hidden.index(b)) for b in range(256))


@lru_cache(maxsize=1)
def library_encoder(vocabulary: bytes, width: int, limit: int = 500_000) -> PieceEncoder:
    """Encodes with the tokenizers library; special tokens' strings are ordinary text. One per worker process, which remembers ``limit`` pieces."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import regex
    from tokenizers import Tokenizer
    tok = Tokenizer.from_buffer(vocabulary)
    tok.encode_special_tokens = True
    kind, code = f"<u{width}", {2: "H", 4: "I"}[width]

    def whole(texts):
        return [np.array(e.ids, dtype=kind).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    # the library's model alone takes a pre-token's bytes as characters; that saves its work per text on offsets
    spelled = {i: ord(c) for i, c in enumerate(byte_characters())}
    model = tok.model

    def encode(tokens):
        made = [[x.id for x in model.tokenize(t.encode("utf-8", "replace").decode("latin-1").translate(spelled))] for t in tokens]
        return [struct.pack(f"<{len(ids)}{code}", *ids) for ids in made]
    return PieceEncoder(encode, regex.compile(BYTE_LEVEL).findall, whole, limit)


def _encode(shared, bounds, end_id, width):
    def encode(batches):
        enc = library_encoder(shared.value, width)
        tail = int(end_id).to_bytes(width, "little")
        edges = np.array(bounds, dtype=np.int64)
        for batch, texts in text_blocks(batches):
            ids = batch.column("doc_id")
            low = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            shard = np.searchsorted(edges, low, side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.array(shard), pa.array([p + tail for p in enc(texts)], pa.binary())],
                                             names=["doc_id", "shard", "ids"])
    return encode


def _write(folder, end_id, width):
    def write(batches):
        now = None
        for batch in batches:
            for doc_id, shard, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "shard", "ids"))):
                if now is None or shard != now.shard:
                    if now:
                        yield now.close()
                    now = ShardWriter(folder, shard, end_id, width)
                now.add(doc_id, data)
        if now:
            yield now.close()
    return write


def write_shards(docs: DataFrame, vocabulary: str, end_id: int, shard_chars: int = 32 << 20, shard_docs: int = 1 << 20,
                 folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode ``docs`` (doc_id, text) and write the shards; the folder and the table of keys (doc_id, ordinal, shard, n).

    A shard holds about ``shard_chars`` characters or ``shard_docs`` documents; a writer holds the keys of one shard in memory,
    not its ids, so a range of ids with long texts, or an id that repeats, makes a longer file but takes no more memory.
    The folder must be one that all executors share.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or scratch_path(spark, "ids")
    with open(vocabulary, "rb") as f:
        data = f.read()
    import json
    model = json.loads(data)["model"]["vocab"]
    width = 2 if max(end_id, *model.values()) < 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    shards = max(1, -(-(size["chars"] or 0) // shard_chars), -(-size["n"] // shard_docs))
    bounds: list[int] = []
    if shards > 1:
        at = [i / shards for i in range(1, shards)]
        got = rows.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * shards)).alias("q")).first()["q"] or []
        bounds = sorted(set(got))
    encoded = rows.mapInArrow(_encode(spark.sparkContext.broadcast(data), bounds, end_id, width), "doc_id bigint, shard int, ids binary")
    dealt = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    keys = dealt.mapInArrow(_write(folder, end_id, width), "doc_id bigint, ordinal bigint, shard int, n bigint")
    keys.write.parquet(f"{folder}/keys")
    return folder, spark.read.schema(keys.schema).parquet(f"{folder}/keys")


def _read(folder, bases):
    def read(batches):
        shard, now = None, None
        for batch in batches:
            col = batch.column("shard").to_numpy()
            edges = np.flatnonzero(np.diff(col)) + 1
            for part in (batch.slice(a, b - a) for a, b in zip([0, *edges], [*edges, len(col)]) if b > a):
                if part.column("shard")[0].as_py() != now:
                    now = part.column("shard")[0].as_py()
                    shard = Shard(folder, now)
                ids = part.column("doc_id")
                keys = key_hash(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False),
                                part.column("ordinal").to_numpy())
                known, starts, counts = shard.find(keys)
                if not known.all():
                    raise KeyError(f"shard {now} misses a key")
                crc = [zlib.crc32(shard.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts + bases[now]), pa.array(counts), pa.array(crc, pa.int64())],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return read


def read_digests(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each key, looked up in the shards' indexes and read from their payloads."""
    # one row per shard
    totals = keys.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()
    bases, at = {}, 0
    for r in totals:
        bases[r["shard"]] = at
        at += r["n"]
    asked = (keys.select("doc_id", "ordinal", "shard").repartitionById(max(1, len(totals)), F.col("shard"))
             .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ordinal"))
    return asked.mapInArrow(_read(folder, bases), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
