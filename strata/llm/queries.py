"""The registered query of each operator, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, exact_dedup, html_extract, langid, minhash, mixing, ngram_join, periodic, quality_knn, quality_rules, token_files, url_filter
from .common import id_remainder, prepare, read_table
from .oracles import SQL

#: Rules (host, path, verdict) for `pages`.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Sites whose URLs are listed for blocking, under each of these domains.
LISTED = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_UNDER = ["example.com", "example.net", "example.org"]
#: Appended to each document by `op3`.
END_ID = 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs, usable=~held_out)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(read_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder, keys = token_files.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_files.read_digests(spark, folder, keys)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(read_table(spark, sf_dir, "documents"), size=4, percent=80)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(read_table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = [(host, path, verdict, False) for host, path, verdict in RULES]
    entries += [(f"{site}.{domain}", "/", "block", True) for site in LISTED for domain in LISTED_UNDER]
    frame = spark.createDataFrame(entries, "host string, path string, verdict string, listed boolean")
    return url_filter.judge(read_table(spark, sf_dir, "pages"), frame).drop("listed")


def op7_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality_knn.train(docs, labels, usable=~held_out)
    return quality_knn.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality_rules.judge(read_table(spark, sf_dir, "documents"), labels)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.slots(docs, mixing.plan(docs))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return alignment.link_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read_table(spark, sf_dir, "documents"), size=5, percent=80)


def repeating(doc_id: int | None, n: int) -> list[int] | None:
    """The word numbers that `op13` looks at: from a place on, the words of some documents repeat. A null id keeps its words."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*range(a), *(a + (i - a) % p for i in range(a, n))]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = periodic.find_runs(docs, exponent=4, min_length=6, rewrite=repeating)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return runs.select("doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
                       F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_exact_dedup, op3_token_files, op4_minhash, op5_html_extract, op6_url_filter,
                                   op7_quality_knn, op8_quality_rules, op9_byte_bpe, op10_mixing, op11_alignment, op12_ngram_join, op13_periodic_runs)}
ORACLES = SQL


def queries() -> dict:
    def prepared(f):
        def run(spark, sf_dir):
            prepare(spark)
            return f(spark, sf_dir)
        return run
    return {name: prepared(f) for name, f in QUERIES.items()}
