"""Language classification.

All lookups are literal maps in the plan: no join, no shuffle, and the
predicate ``lang <> 'unknown'`` stays a plain filter Catalyst can push.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import (DEFAULT_RULESET, EXT_LANG, KINDS_BY_LANG, LANG_MARKERS,
                              RULESET_BY_LANG)
from ..functions.lines import base_name, ext_of


def _map_lit(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def lang_of_path(path) -> Column:
    """Language by the last extension of the base name (case-sensitive)."""
    ext = ext_of(base_name(path))
    return F.coalesce(F.try_element_at(_map_lit(EXT_LANG), ext), F.lit("unknown"))


def with_lang(df: DataFrame, path_col: str = "file_path", keep_unknown: bool = False) -> DataFrame:
    """P1 + P2: add ``lang`` and drop rows of unknown language."""
    out = df.withColumn("lang", lang_of_path(path_col))
    return out if keep_unknown else out.filter(F.col("lang") != "unknown")


def ruleset_for(lang) -> Column:
    """Rule-set name for a language, case-insensitive, default 'auto'."""
    lc = F.lower(F.col(lang) if isinstance(lang, str) else lang)
    return F.coalesce(F.try_element_at(_map_lit(RULESET_BY_LANG), lc), F.lit(DEFAULT_RULESET))


def _member_of(toks):
    arr = F.array(*[F.lit(s) for s in toks])
    return lambda x: F.array_contains(arr, x)


def marker_tokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), 0)


def guess_lang(tokens, markers=LANG_MARKERS) -> Column:
    """Content language by marker words, computed inside the row.

    Tokens are ``[a-z]+`` runs of the lower-cased text; each marker token
    scores 1 for its language; the best score wins, ties go to the smaller
    language name; no marker at all gives null. The marker table is a small
    driver-side dimension, so it becomes literal arrays (no join, no shuffle).
    """
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    by_lang: dict[str, list[str]] = {}
    for lang, tok in markers:
        by_lang.setdefault(lang, []).append(tok)
    # one pass keeps only marker words; the per-language counts then scan that short array
    tokens = F.filter(tokens, _member_of(sorted({t for _, t in markers})))
    scored = [
        F.struct(
            (-F.size(F.filter(tokens, _member_of(toks)))).alias("neg"),
            F.lit(lang).alias("lang"),
        )
        for lang, toks in sorted(by_lang.items())
    ]
    best = F.array_min(F.array(*scored))
    return F.when(best["neg"] < 0, best["lang"])


def lang_by_content(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", "lang", marker_tokens("text").alias("_tok"))
    return d.select("doc_id", "lang", guess_lang("_tok").alias("guess"))


def lang_confusion(docs: DataFrame) -> DataFrame:
    """Confusion matrix of the guess against the given ``lang``: one row per
    true language, one column per guessed language (partial aggregation,
    a handful of output rows)."""
    g = lang_by_content(docs)
    langs = sorted({m[0] for m in LANG_MARKERS})
    return g.groupBy("lang").agg(
        *[F.count_if(F.col("guess") == x).cast("bigint").alias(f"n_{x}") for x in langs],
        F.count_if(F.col("guess").isNull()).cast("bigint").alias("n_none"),
        F.count(F.lit(1)).cast("bigint").alias("n_docs"),
    )


def kinds_dim(spark) -> DataFrame:
    """(lang, kind) rows."""
    rows = [(lang, k) for lang, ks in KINDS_BY_LANG.items() for k in ks]
    return spark.createDataFrame(rows, "lang string, kind string")


def supported_langs(files_with_lang: DataFrame) -> DataFrame:
    """Languages present in the files that the chunker has kinds for,
    with file counts (semi-join against the small kinds dimension)."""
    spark = files_with_lang.sparkSession
    kinds = kinds_dim(spark).groupBy("lang").agg(F.count(F.lit(1)).cast("bigint").alias("n_kinds"))
    counts = files_with_lang.groupBy("lang").agg(F.count(F.lit(1)).cast("bigint").alias("n_files"))
    return counts.join(F.broadcast(kinds), "lang", "inner")
