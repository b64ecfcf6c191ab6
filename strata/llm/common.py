"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

#: Rows of one Arrow batch. A batch of whole texts then stays small next to a worker's memory.
ARROW_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """Ship this package to the Python workers and bound their Arrow batches."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: what reads the table neither repeats the work nor
    depends on files of one executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """A name for each wanted temporary column that no column of ``df`` has (names differ by more than case)."""
    used, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def id_remainder(col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def unit_hash(col: Column, salt: int) -> Column:
    """A fixed pseudo-random number in [0, 1) per value, to draw samples that a rerun repeats."""
    return F.pmod(F.xxhash64(col, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit words (all bits of the result depend on all bits of the input)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose column ``text`` holds about ``limit`` characters at most
    (one longer text makes a slice of its own), with the texts; null counts as empty."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]
