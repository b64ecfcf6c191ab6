"""Quality scores by votes of the nearest labelled documents in a latent-semantic space.

Features are hashed pairs of bytes and a few kinds of words (repeated, upper case,
with symbols, lines seen before), weighted by the square root of their number and
by inverse document frequency over all documents. A truncated singular value
decomposition of labelled documents gives the latent space. The labelled vectors
are broadcast; every document's cosine with every one of them is computed exactly,
in blocks, and the nearest vote with a power of their similarity.

The labelled documents are a sample of at most about ``train_rows``, drawn by a hash
of the id: that documented bound makes the broadcast small at every size. Document
frequencies cover all rows.

Defined results: null text counts as empty. A text without features is as near to
every labelled one and gets the share of label 1 among them; without any labelled
text every score is 0.5. Labels that contradict each other for one id count as 1. Rows
without a label, or with a null one, are scored but teach nothing. Rows are kept as
they come; other columns play no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, prepare, text_blocks, unit_hash

PAIRS = 1024
FEATURES = PAIRS + 5
SYMBOL = re.compile(r"[#*$%&|<>{}!=_~^]")
#: Pair of bytes -> feature.
_HASHED = (mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(77)) % np.uint64(PAIRS)).astype(np.int16)
STEP = 1 << 20


def counts(text: str) -> np.ndarray:
    """Number of each feature in a whole text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    out = np.zeros(FEATURES, dtype=np.int64)
    for lo in range(0, max(len(raw) - 1, 0), STEP):
        part = raw[lo:lo + STEP + 1].astype(np.uint16)
        out[:PAIRS] += np.bincount(_HASHED[(part[:-1] << 8) | part[1:]], minlength=PAIRS)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    out[PAIRS:] = (sum(map(eq, words, words[1:])), sum(map(str.isupper, words)), len(SYMBOL.findall(text)),
                   sum(map(str.isdigit, words)), len(lines) - len(set(lines)))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass
class Model:
    idf: np.ndarray
    space: np.ndarray     # features x dimensions
    vectors: np.ndarray   # labelled rows x dimensions, unit length
    labels: np.ndarray
    neighbours: int

    def vectors_of(self, tf: np.ndarray) -> np.ndarray:
        return _unit((_unit(np.sqrt(tf).astype(np.float32) * self.idf) @ self.space).astype(np.float32))

    def scores(self, tf: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(tf), 0.5)
        out = np.empty(len(tf))
        k = min(self.neighbours, len(self.labels))
        for lo in range(0, len(tf), 256):
            cosine = self.vectors_of(tf[lo:lo + 256]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** 8
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1)
            out[lo:lo + 256] = np.where(total > 0, vote / np.where(total > 0, total, 1), self.labels.mean())
        return np.clip(out, 0, 1)


def _frequencies(batches):
    total, rows = np.zeros(FEATURES, dtype=np.int64), 0
    for _, texts in text_blocks(batches):
        for t in texts:
            total += counts(t) > 0
            rows += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(FEATURES), -1), pa.int64()), pa.array(np.append(total, rows), pa.int64())],
                                     names=["feature", "n"])


def _count_rows(batches):
    for batch, texts in text_blocks(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"),
                                          pa.array([counts(t).astype(np.int32).tobytes() for t in texts], pa.binary())], names=["doc_id", "label", "tf"])


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, train_rows: int = 4096, dimensions: int = 64, neighbours: int = 25) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, label); ``usable`` says which label rows may teach."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", "text")
    df = {r["feature"]: r["n"] for r in docs.mapInArrow(_frequencies, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    idf = np.log((1 + df.get(-1, 0)) / (1 + np.array([df.get(i, 0) for i in range(FEATURES)]))).astype(np.float32) + 0.1
    known = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (usable if usable is not None else F.lit(True)))
    known = known.groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    total = known.count()
    sample = known.where(unit_hash(F.col("doc_id"), 7) < train_rows / max(total, 1))  # so many rows on average
    # of a repeated id the lowest text teaches, so that the rows fetched are no more than those sampled
    rows = (docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
            .mapInArrow(_count_rows, f"doc_id {dict(docs.dtypes)['doc_id']}, label int, tf binary").toArrow().sort_by("doc_id"))
    tf = np.array([np.frombuffer(x, dtype=np.int32) for x in rows.column("tf").to_pylist()]).reshape(-1, FEATURES)
    x = _unit(np.sqrt(tf).astype(np.float32) * idf).astype(np.float64)
    _, axes = np.linalg.eigh(x.T @ x)  # the right singular vectors
    space = axes[:, ::-1][:, :dimensions].astype(np.float32)
    model = Model(idf, space, np.zeros((0, dimensions), np.float32), np.array(rows.column("label").to_pylist(), dtype=np.float64), neighbours)
    model.vectors = model.vectors_of(tf)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")

    def run(batches):
        for batch, texts in text_blocks(batches):
            s = shared.value.scores(np.array([counts(t) for t in texts]).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")
