"""Source-tree scan, listed and read in tasks.

``scan_source_tree(spark, root, extensions, exclude_dirs)`` lists the tree level by
level: the directories of a level are dealt to tasks, each lists its own, and what
they found is written to the shared folder; the directories in it, without the
excluded ones, are the next level. A directory whose base name is excluded is never
entered, at any depth; the root always is. Files are then dealt to tasks, which read and
decode them. The driver sees counts only.

``root`` is an absolute path or a URI that pyarrow opens (``file``, ``hdfs``, ``s3``, ``gs``);
every executor must reach it. Names that start with ``_`` or ``.`` are kept, unlike in the
built-in ``binaryFile`` source. Links to directories of a local tree are not followed.
Files that are gone, may not be read or aren't UTF-8 are skipped, and so are directories that
are gone or closed; any other error fails the task, which Spark repeats. A missing or empty root gives no
rows. Text comes back with universal newlines (``\\r\\n`` and ``\\r`` become ``\\n``).
The names of one directory are held by one task.
"""

from __future__ import annotations

import math
import os

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

SCHEMA = "path string, name string, size long, text string"
LISTED = "rel string, size long, is_dir boolean"
#: Rows of one listed batch, and text bytes of one read batch.
LISTED_ROWS, READ_BYTES = 10_000, 8 << 20
MOST_TASKS = 100_000


def _opened(root: str):
    files, base = pafs.FileSystem.from_uri(root)
    return files, base.rstrip("/")


def _lister(root: str, extensions: tuple, excluded: frozenset):
    def run(batches):
        files, base = _opened(root)
        for batch in batches:
            for rel in batch.column("rel").to_pylist():
                try:
                    found = files.get_file_info(pafs.FileSelector(base + rel or "/"))
                except (FileNotFoundError, NotADirectoryError, PermissionError):
                    continue
                rows = []
                for f in found:
                    if f.type == pafs.FileType.Directory:
                        linked = files.type_name == "local" and os.path.islink(f.path)
                        if f.base_name not in excluded and not linked:
                            rows.append((f"{rel}/{f.base_name}", None, True))
                    elif f.type == pafs.FileType.File and (not extensions or f.base_name.endswith(extensions)):
                        rows.append((f"{rel}/{f.base_name}", f.size, False))
                for i in range(0, len(rows), LISTED_ROWS):
                    rels, sizes, dirs = zip(*rows[i:i + LISTED_ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array(rels, pa.string()), pa.array(sizes, pa.int64()), pa.array(dirs, pa.bool_())],
                                                     names=["rel", "size", "is_dir"])
    return run


def list_tree(spark: SparkSession, root: str, extensions=(), exclude_dirs=()) -> DataFrame:
    """(rel, size) of every file: its path below the root, with a slash in front. One job a level of the tree."""
    ship_package(spark)
    run = _lister(root, tuple(extensions), frozenset(exclude_dirs))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    level, paths = spark.createDataFrame([("",)], "rel string"), []
    while not paths or not level.isEmpty():
        paths.append(scratch_path(spark, "tree"))
        level.repartition(tasks, "rel").mapInArrow(run, LISTED).write.parquet(paths[-1])
        level = spark.read.schema(LISTED).parquet(paths[-1]).where("is_dir").select("rel")
    return spark.read.schema(LISTED).parquet(*paths).where("not is_dir").select("rel", "size")


def _reader(root: str):
    def run(batches):
        files, base = _opened(root)

        def out(rows):
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.string()))]
            return pa.RecordBatch.from_arrays(columns, names=["path", "name", "size", "text"])
        for batch in batches:
            rows, held = [], 0
            for rel in batch.column("rel").to_pylist():
                try:
                    with files.open_input_file(base + rel) as f:
                        raw = f.read()
                    text = raw.decode("utf-8")
                except (FileNotFoundError, PermissionError, UnicodeDecodeError):
                    continue
                rows.append((root.rstrip("/") + rel, rel.rsplit("/", 1)[1], len(raw), text.replace("\r\n", "\n").replace("\r", "\n")))
                held += len(raw)
                if held >= READ_BYTES:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)
    return run


def scan_source_tree(spark: SparkSession, root: str, extensions=(), exclude_dirs=(), files_per_task: int = 500,
                     bytes_per_task: int = 64 << 20) -> DataFrame:
    """(path, name, size, text) of every file of the tree whose name ends with one of ``extensions`` (all, if there are none)."""
    files = list_tree(spark, root, extensions, exclude_dirs)
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = min(MOST_TASKS, max(1, math.ceil(n / files_per_task), math.ceil(size / bytes_per_task)))
    return files.repartition(tasks).mapInArrow(_reader(root), SCHEMA)
