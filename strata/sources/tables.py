"""Readers for the parquet tables and the derived ``code_corpus`` view.

Every reader returns a lazy DataFrame; projections and filters placed on
top are pushed into the parquet scan by Catalyst (``PushedFilters`` /
``ReadSchema`` in the plan).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dims import CORPUS_NAME_SUFFIXES

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# tables whose rows carry whole texts: per-row work is CPU-heavy
TEXT_TABLES = {"documents", "pages", "conversations", "part"}


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Round-robin repartition when a scan yields fewer partitions than
    ``factor`` x the cluster's default parallelism (small files or a single
    Parquet row group read by one task). On a large input the scan already
    has far more splits and this is a no-op, so no text is shuffled."""
    try:
        target = factor * df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # no RDD view (e.g. a Connect session): leave the scan as it is
        return df
    return df.repartition(target) if n < target else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if name in TEXT_TABLES else df


def _nl():
    return F.lit("\n")


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small source files built from ``part`` (one file per part key):
    python files with an ``eval`` call, C files with ``strcpy`` and
    javascript files assigning ``innerHTML``. Columns: file_id, lang, code."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey").cast("string")
    s = F.col("p_size").cast("string")
    nl = _nl()
    py = F.concat(
        F.lit("import os"), nl, nl, F.lit("def f"), k, F.lit("(x):"), nl,
        F.lit("    y = x + "), s, nl, F.lit("    return eval(y)"), nl, nl,
        F.lit("class C"), k, F.lit(":"), nl, F.lit("    def run(self):"), nl,
        F.lit("        return "), s, nl,
    )
    c = F.concat(
        F.lit("#include <string.h>"), nl, F.lit("int g"), k, F.lit("(char *s) {"), nl,
        F.lit("  char b["), s, F.lit("];"), nl, F.lit("  if (s) {"), nl,
        F.lit("    strcpy(b, s);"), nl, F.lit("  }"), nl, F.lit("  return 0;"), nl, F.lit("}"), nl,
    )
    js = F.concat(
        F.lit("function h"), k, F.lit("(u) {"), nl, F.lit("  document.body.innerHTML = u;"), nl,
        F.lit("}"), nl, F.lit("const K"), k, F.lit(" = "), s, F.lit(";"), nl,
    )
    m = F.col("p_partkey") % 3
    return p.select(
        F.col("p_partkey").alias("file_id"),
        F.when(m == 0, "python").when(m == 1, "c").otherwise("javascript").alias("lang"),
        F.when(m == 0, py).when(m == 1, c).otherwise(js).alias("code"),
        F.col("p_size"),
    )


def corpus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code_corpus with a file path whose suffix cycles through a fixed list
    (covers upper-case, double and missing extensions)."""
    cc = code_corpus(spark, sf_dir)
    suffixes = F.array(*[F.lit(x) for x in CORPUS_NAME_SUFFIXES])
    idx = (F.col("file_id") % len(CORPUS_NAME_SUFFIXES)).cast("int")
    name = F.concat(F.lit("src/m"), (F.col("file_id") % 7).cast("string"), F.lit("/f"),
                    F.col("file_id").cast("string"), F.element_at(suffixes, idx + 1))
    return cc.withColumn("file_path", name)


# The same corpus as SQL text, for the DuckDB oracles (kept in step with code_corpus()).
CODE_CORPUS_SQL = r"""
SELECT p_partkey AS file_id,
  CASE WHEN p_partkey % 3 = 0 THEN 'python' WHEN p_partkey % 3 = 1 THEN 'c' ELSE 'javascript' END AS lang,
  CASE WHEN p_partkey % 3 = 0 THEN
    concat('import os', chr(10), chr(10), 'def f', p_partkey, '(x):', chr(10), '    y = x + ', p_size, chr(10), '    return eval(y)', chr(10), chr(10), 'class C', p_partkey, ':', chr(10), '    def run(self):', chr(10), '        return ', p_size, chr(10))
  WHEN p_partkey % 3 = 1 THEN
    concat('#include <string.h>', chr(10), 'int g', p_partkey, '(char *s) {', chr(10), '  char b[', p_size, '];', chr(10), '  if (s) {', chr(10), '    strcpy(b, s);', chr(10), '  }', chr(10), '  return 0;', chr(10), '}', chr(10))
  ELSE
    concat('function h', p_partkey, '(u) {', chr(10), '  document.body.innerHTML = u;', chr(10), '}', chr(10), 'const K', p_partkey, ' = ', p_size, ';', chr(10)) END AS code,
  p_size
FROM part
"""


def corpus_paths_sql() -> str:
    arr = "[" + ", ".join("'" + s + "'" for s in CORPUS_NAME_SUFFIXES) + "]"
    return (
        "SELECT *, concat('src/m', CAST(file_id % 7 AS VARCHAR), '/f', CAST(file_id AS VARCHAR), "
        f"{arr}[CAST(file_id % {len(CORPUS_NAME_SUFFIXES)} AS INTEGER) + 1]) AS file_path "
        f"FROM ({CODE_CORPUS_SQL})"
    )
