"""Sinks and result files.

Results are written by the executors (``df.write``), never gathered on
the driver; nested verdict structs need no conversion step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_results(df: DataFrame, path: str, fmt: str = "json", partition_by: list[str] | None = None) -> None:
    """K1: write scan rows (nested structs as JSON objects / parquet groups)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


def read_results(spark: SparkSession, path: str, envelope: bool = True) -> DataFrame:
    """Read an earlier result file. ``envelope=True`` reads whole-file
    envelopes ``{"status":..,"repo_name":..,"results":[...]}`` and explodes
    the results; otherwise JSON lines of rows."""
    if not envelope:
        return spark.read.json(path)
    env = spark.read.option("multiLine", True).json(path)
    return env.select("repo_name", "status", F.explode_outer("results").alias("r")).select("repo_name", "status", "r.*")


def result_envelope(rows: DataFrame, repo: str, failed: str, flagged: str) -> DataFrame:
    """K3: one status row per repository: SUCCESS when no row of the repo
    failed, else FAILURE with an error text; counts only (partial
    aggregation; the rows themselves go to ``save_results`` partitioned by
    repository instead of into one array per repository)."""
    agg = rows.groupBy(repo).agg(F.count(F.lit(1)).cast("bigint").alias("n_results"),
                                 F.count_if(F.col(flagged)).cast("bigint").alias("n_flagged"),
                                 F.count_if(F.col(failed)).cast("bigint").alias("n_rejects"))
    ok = F.col("n_rejects") == 0
    return agg.select(repo, F.when(ok, "SUCCESS").otherwise("FAILURE").alias("status"), "n_results", "n_flagged",
                      "n_rejects", F.when(~ok, F.concat(F.col("n_rejects").cast("string"), F.lit(" result(s) failed")))
                      .alias("error"))


def write_index(vectors: DataFrame, path: str, partition_col: str) -> None:
    """K4: persist a vector table partitioned by its filter column."""
    vectors.write.mode("overwrite").partitionBy(partition_col).parquet(path)


def read_index(spark: SparkSession, path: str, partition_col: str | None = None, value=None) -> DataFrame:
    """K4: reload; a filter on the partition column prunes directories."""
    df = spark.read.parquet(path)
    return df if partition_col is None else df.filter(F.col(partition_col) == value)
