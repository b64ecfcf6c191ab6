"""Vectors and retrieval.

* X1 default embedding: hashed token one-hots averaged over *all* tokens of
  the text (bucket = first 8 hex digits of sha256(token) mod ``dim``):
  tokens are exploded and hashed under whole-stage codegen and counted per
  (text, bucket) with map-side combine, so at most ``dim`` rows per text are
  shuffled. A user encoder plugs in as an iterator ``pandas_udf``
  (``encoder_udf``) loading its model once per Python worker.
* X2, X3 and X6 are in ``knn``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMBED_DIM = 16
TOKEN_RE = "[a-z0-9_]+"


def embedding_table(df: DataFrame, id_col: str, text: str, dim: int = EMBED_DIM) -> DataFrame:
    """(id, embedding array<double>) for every text with at least one token.

    Tokens are exploded and hashed in whole-stage codegen; counts per
    (id, bucket) are combined map-side, so at most ``dim`` rows per text
    reach the shuffle; the vector is assembled from those few rows."""
    from ..functions.lines import explode_rows
    toks = explode_rows(df.select(id_col, F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN_RE), 0).alias("_tk")),
                        [id_col], "_tk", "tok")
    b = toks.select(id_col, (F.conv(F.substring(F.sha2("tok", 256), 1, 8), 16, 10).cast("bigint") % dim)
                    .cast("int").alias("dim"))
    counts = b.groupBy(id_col, "dim").agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("dim", "c"))).alias("_m"),
                                     F.sum("c").alias("_n"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                      lambda j: F.coalesce(F.try_element_at("_m", j), F.lit(0)) / F.col("_n"))
    return per.select(id_col, vec.alias("embedding"))


def with_embedding(df: DataFrame, text: str, id_col: str, out: str = "embedding", dim: int = EMBED_DIM) -> DataFrame:
    """``df`` plus its X1 embedding (left join on the id; null without tokens)."""
    return df.join(embedding_table(df, id_col, text, dim).withColumnRenamed("embedding", out), id_col, "left")


def l2(a, b) -> Column:
    """Euclidean distance of two equal-length arrays, summed in double."""
    sq = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def encoder_udf(load_model, dim: int):
    """Wrap a user encoder (``load_model() -> callable(list[str]) ->
    array``) as an iterator pandas_udf: the model loads once per worker and
    sees Arrow batches."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for s in batches:
            vecs = model(list(s.fillna("")))
            yield pd.Series([list(map(float, v))[:dim] for v in vecs])
    return enc


# ------------------------------------------------------------------ X4 / X7 hybrid context

def hybrid_context(files: DataFrame, kb: DataFrame, pattern_hits: DataFrame, sem_k: int = 3, limit: int = 5) -> DataFrame:
    """Per file, semantic KB hits of the same language (nearest first,
    at most ``sem_k``), then pattern hits; duplicates dropped on their key;
    the first ``limit`` rows.

    files: (file_id, lang, embedding); kb: (kb_id, language, text,
    vulnerability_type, risk_level, embedding) - a small dimension, broadcast;
    pattern_hits: (file_id, pattern, line_no, line_code)."""
    sem = (files.join(F.broadcast(kb), files.lang == kb.language)
           .select("file_id", "kb_id", F.col("vulnerability_type").alias("k1"), F.col("text").alias("k2"),
                   F.col("text").alias("text"), "risk_level",
                   l2(files.embedding, kb.embedding).alias("_d")))
    ws = Window.partitionBy("file_id").orderBy("_d", "kb_id")
    sem = (sem.withColumn("_r", F.row_number().over(ws)).filter(F.col("_r") <= sem_k)
           .select("file_id", F.lit(0).alias("_src"), F.col("_r").cast("long").alias("_o1"), F.lit("").alias("_o2"),
                   F.concat_ws("\u0001", "k1", "k2").alias("_key"), F.lit("semantic").alias("kind"), "text", "risk_level"))
    pat = pattern_hits.select(
        "file_id", F.lit(1).alias("_src"), F.col("line_no").cast("long").alias("_o1"), F.col("pattern").alias("_o2"),
        F.concat_ws("\u0001", "line_code", F.col("line_no").cast("string")).alias("_key"), F.lit("pattern").alias("kind"),
        F.concat(F.lit("Pattern match at line "), F.col("line_no").cast("string"), F.lit(": "), F.col("line_code")).alias("text"),
        F.lit("High").alias("risk_level"))
    u = sem.unionByName(pat)
    order = [F.col("_src"), F.col("_o2"), F.col("_o1")]
    wk = Window.partitionBy("file_id", "_key").orderBy(*order)
    first = u.withColumn("_k", F.row_number().over(wk)).filter(F.col("_k") == 1)
    wf = Window.partitionBy("file_id").orderBy(*order)
    return (first.withColumn("rank", F.row_number().over(wf)).filter(F.col("rank") <= limit)
            .select("file_id", F.col("rank").cast("int").alias("rank"), "kind", "text", "risk_level"))


def context_digest(ctx: DataFrame) -> DataFrame:
    """X7: '- text (Risk: level)' lines in rank order (at most ``limit`` per file)."""
    return ctx.groupBy("file_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "text", "risk_level"))),
        lambda x: F.concat(F.lit("- "), x["text"], F.lit(" (Risk: "), x["risk_level"], F.lit(")"))), "\n").alias("context"))
