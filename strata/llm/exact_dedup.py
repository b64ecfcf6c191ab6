"""Exact deduplication with an extendible-hash index on shared files.

1. Each map task chains its rows by 64-bit hash and compares bytes, so that
   copies within a task fold into one *entry*; every row remembers its entry.
   Rows and entries are written once, to the shared folder.
2. The directory starts with one bucket and doubles: a bucket with more entries
   or bytes than a page holds splits by the next bit of the hash. Its input is
   the number of entries and bytes per hash prefix, never hashes or ids.
3. Owner tasks each get one bucket, i.e. one range of hashes, in hash order.
   They chain entries of equal hash, compare bytes along the chain and write the
   index file: entry -> row that stays and size of the group.
4. Rows look their entry up in the index.

A group of copies that holds a third of all rows reaches its owner as one entry
per map task. Only the chain of one hash is in memory at a time.

Defined results: null text counts as empty; texts are equal if their UTF-8 bytes
are; of equal texts the largest id stays (a null id is smaller than any other);
each of several rows with that same id and text counts, and all of them carry
``kept`` except that of repeated (id, text) rows only the first is kept. An empty table
gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_blocks, written

ROWS = "doc_id bigint, ordinal bigint, entry string, h bigint, sha binary, top_id bigint, n bigint, size bigint, text string"
#: A hash prefix of the directory's input has this many bits at most (2^20 counters).
MAX_BITS = 20
#: A task closes its entries when it holds so many rows.
HELD_ROWS = 1 << 18


def _fold(batches):
    """Rows of one map task with their entries; the row that opens an entry carries its text.

    Entries are closed when their texts or their rows (copies and empty texts hold no further text) reach a bound,
    so memory is bounded; a later copy then opens another entry of the same text, which the owner joins with the first.
    """
    from pyspark import TaskContext

    import xxhash
    task = TaskContext.get().partitionId()
    bound = 64 << 20
    serial = 0
    chains: dict[int, list[list]] = {}
    rows: list[tuple] = []
    held = 0

    def close():
        nonlocal chains, rows, held
        step = 10_000
        for lo in range(0, len(rows), step):
            part = rows[lo:lo + step]
            entries = [r[3] for r in part]
            opens = [r[2] for r in part]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()),
                pa.array([e[0] for e in entries]), pa.array([e[1] for e in entries], pa.int64()),
                pa.array([e[2] for e in entries], pa.binary()), pa.array([e[3] for e in entries], pa.int64()),
                pa.array([e[4] for e in entries], pa.int64()), pa.array([len(e[5]) for e in entries], pa.int64()),
                pa.array([e[5].decode() if o else None for e, o in zip(entries, opens)], pa.string())],
                names=[c.split()[0] for c in ROWS.split(", ")])
        chains, rows, held = {}, [], 0

    for batch, texts in text_blocks(batches):
        for doc_id, t in zip(batch.column("doc_id").to_pylist(), texts):
            data = t.encode("utf-8", "replace")
            h = xxhash.xxh3_64_intdigest(data)
            h -= (h >> 63) << 64
            chain = chains.setdefault(h, [])
            entry = next((e for e in chain if e[5] == data), None)
            opened = entry is None
            if opened:
                entry = [f"{task}-{serial}", h, hashlib.sha256(data).digest(), doc_id, 0, data]
                chain.append(entry)
                held += len(data)
            entry[4] += 1
            if doc_id is not None and (entry[3] is None or doc_id > entry[3]):
                entry[3] = doc_id
            rows.append((doc_id, serial, opened, entry))
            serial += 1
        if held > bound or len(rows) >= HELD_ROWS:
            yield from close()
    yield from close()


def directory(counts: list[tuple[int, int, int]], bits: int, page_entries: int, page_bytes: int) -> list[tuple[int, int]]:
    """Buckets (first prefix, local depth) after doubling, in order of the prefixes.

    counts: (prefix of ``bits`` bits, entries, bytes). A bucket that is still overfull at depth ``bits`` stays:
    its owner takes longer but streams it.
    """
    sums = [{p: (n, b) for p, n, b in counts}]
    for _ in range(bits):
        up: dict[int, tuple[int, int]] = {}
        for p, (n, b) in sums[-1].items():
            m, c = up.get(p >> 1, (0, 0))
            up[p >> 1] = (m + n, c + b)
        sums.append(up)
    out, depth, level = [], 0, [0]
    while level:
        deeper = []
        for p in level:
            n, b = sums[bits - depth].get(p, (0, 0))
            if depth < bits and (n > page_entries or b > page_bytes):
                deeper += [2 * p, 2 * p + 1]  # the directory doubles, this bucket splits
            else:
                out.append((p << (bits - depth), depth))
        level, depth = deeper, depth + 1
    return sorted(out)


def _own(batches):
    """Index rows of one bucket's entries, which come in order of hash."""
    chain: list[list] = []
    now = None
    out: list[tuple] = []

    def flush():
        for _, top, n, row, names in chain:
            out.extend((name, top, n, row) for name in names)
        chain.clear()

    def batch_of(part):
        names, tops, ns, keepers = zip(*part)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(tops, pa.int64()),
                                           pa.array(ns, pa.int64()), pa.array(keepers, pa.string())],
                                          names=["entry", "keep_id", "group_size", "keeper"])

    for batch, texts in text_blocks(batches):
        cols = [batch.column(c).to_pylist() for c in ("h", "entry", "top_id", "n")]
        for h, name, top, n, text in zip(*cols, texts):
            if h != now:
                flush()
                now = h
                if len(out) >= 10_000:
                    yield batch_of(out)
                    out.clear()
            data = text.encode()
            found = next((c for c in chain if c[0] == data), None)
            if found is None:
                chain.append([data, top, n, name, [name]])
                continue
            found[2] += n
            found[4].append(name)
            if top is not None and (found[1] is None or top > found[1]):
                found[1], found[3] = top, name
    flush()
    if out:
        yield batch_of(out)


def dedup(docs: DataFrame, page_entries: int = 100_000, page_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    rows = written(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_fold, ROWS), "dedup-rows")
    index, _ = build_index(rows, page_entries, page_bytes)
    members = rows.select("doc_id", "ordinal", "entry", "sha", "top_id")
    # of rows that repeat (id, text) one is kept: the first with the largest id in the entry that holds it
    first = (rows.where("doc_id <=> top_id").groupBy("entry").agg(F.min("ordinal").alias("first")))
    index = index.join(first, "entry", "left")
    joined = members.join(index, "entry")
    return joined.select(
        "doc_id", "keep_id", "group_size",
        ((F.col("entry") == F.col("keeper")) & (F.col("ordinal") == F.col("first"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def build_index(rows: DataFrame, page_entries: int, page_bytes: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The written index (entry, keep_id, group_size, keeper) of the entries in ``rows``, and its directory."""
    spark = rows.sparkSession
    entries = rows.where(F.col("text").isNotNull())
    total = entries.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    pages = max(total["n"] / page_entries, (total["b"] or 0) / page_bytes, 1)
    bits = min(MAX_BITS, math.ceil(math.log2(pages)) + 4)
    prefix = F.shiftrightunsigned(F.col("h"), 64 - bits).cast("int")
    counts = entries.groupBy(prefix.alias("p")).agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    buckets = directory([(r["p"], r["n"], r["b"]) for r in counts], bits, page_entries, page_bytes)
    # the directory: one cell per prefix (2^bits of them at most), pointing to its bucket
    cells = [(p, i) for i, (first, depth) in enumerate(buckets) for p in range(first, first + (1 << (bits - depth)))]
    table = spark.createDataFrame(pa.table({"p": pa.array([c[0] for c in cells], pa.int32()),
                                            "bucket": pa.array([c[1] for c in cells], pa.int32())}))
    owned = (entries.select("h", "entry", "top_id", "n", "text", prefix.alias("p")).join(F.broadcast(table), "p").drop("p")
             .repartitionById(len(buckets), F.col("bucket")).sortWithinPartitions("h", "entry"))
    index = owned.mapInArrow(_own, "entry string, keep_id bigint, group_size bigint, keeper string")
    return written(index, "dedup-index"), buckets
