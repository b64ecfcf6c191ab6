"""E1 as one plan: files -> definition chunks -> rule findings -> work key
-> verdict per distinct key -> join back to every chunk.

The request table is materialised once (see ``verdicts.scan_verdicts``);
everything else is one lazy plan whose exchanges are Spark's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dims import SCAN_EXTENSIONS
from ..functions.lines import explode_rows, lines_l2, py_strip
from ..operators import blocks as B
from ..operators import chunking as C
from ..operators import rules as R
from ..operators import sinks
from ..operators import verdicts as V
from ..operators.langs import with_lang
from ..sources.sourcetree import scan_source_tree


def scan_source(files: DataFrame, id_col: str = "file_id", lang: str = "lang", code: str = "code",
                verdict_fn=V.default_verdict_fn, parallelism: int | None = None, cache: DataFrame | None = None) -> DataFrame:
    """One row per chunk with its verdict: (id, chunk_no, start_line,
    end_line, chunk_hash, lang, work_key, code, is_vulnerability, cwe, severity, n_flagged,
    vulnerable_lines, explanation, fix_code, failed, error).

    ``vulnerable_lines`` holds the verdict's lines that the chunk has, as (line of the file,
    trimmed code), V2; ``fix_code`` is guarded by V3. A failed call gives V4's record with
    ``failed`` and ``error``; ``sinks.result_envelope`` counts them. ``cache`` holds
    verdicts by work key (columns of VERDICT_OUT); its keys aren't called."""
    chunks = B.block_chunks(files.select(id_col, lang, code), [id_col, lang], code, lang)
    f = R.with_findings(chunks, "text", lang)
    req = f.select(F.struct(id_col, "chunk_no", "start_line", "end_line", F.col("hash").alias("chunk_hash"), F.col(lang).alias("lang")).alias("_k"),
                   F.col(lang).alias("lang"), R.work_key("text", "findings").alias("work_key"),
                   V.findings_for_fn("findings").alias("findings_json"), F.col("text").alias("code"))
    out = V.scan_verdicts(req, ["_k"], verdict_fn, parallelism, cache)
    said = F.transform(F.coalesce("lines", F.array().cast("array<int>")), lambda n: F.struct(n.alias("lineNum"), F.lit("").alias("lineCode")))
    out = out.withColumns({"_said": V.clip_lines(said, F.col("code")), "_text": lines_l2("code")})
    lines = F.transform("_said", lambda x: F.struct((F.col("_k.start_line") + x["lineNum"] - 1).cast("int").alias("line"),
                                                    py_strip(F.element_at("_text", x["lineNum"])).alias("code")))
    return out.select("_k.*", "work_key", "code", "is_vulnerability", "cwe", "severity", F.col("n_lines").alias("n_flagged"),
                      lines.alias("vulnerable_lines"), "explanation", V.guard_fix(F.col("fix"), F.col("code")).alias("fix_code"),
                      F.col("error").isNotNull().alias("failed"), "error")


def scan_tree(spark: SparkSession, root: str, out: str, repo: str, extensions=tuple(SCAN_EXTENSIONS), exclude_dirs=(),
              verdict_fn=V.default_verdict_fn, parallelism: int | None = None, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """S1 to K3 in one flow: files of a tree, their language (files of unknown language go), ``scan_source`` with cached verdicts,
    rows written to ``out/rows`` and one status row to ``out/envelope``. Returns both as written."""
    files = with_lang(scan_source_tree(spark, root, extensions, exclude_dirs).withColumnRenamed("path", "file_path"))
    rows = scan_source(files, "file_path", "lang", "text", verdict_fn, parallelism, cache).withColumn("repo", F.lit(repo))
    sinks.save_results(rows, f"{out}/rows", "parquet")
    rows = spark.read.parquet(f"{out}/rows")
    sinks.save_results(sinks.result_envelope(rows, "repo", "failed", "is_vulnerability"), f"{out}/envelope", "parquet")
    return rows, spark.read.parquet(f"{out}/envelope")


def tree_windows(spark: SparkSession, root: str) -> DataFrame:
    """Windows of 20 lines (C3) of every C source and header of a tree, no directory left out:
    (path, name, chunk_no, start_line, end_line, text)."""
    files = C.with_fixed_line_chunks(scan_source_tree(spark, root, (".c", ".h")), "text")
    return explode_rows(files, ["path", "name"], "chunks", "c").select("path", "name", "c.*")
