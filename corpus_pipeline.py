"""The corpus pipeline: documents in, digests of token ids out.

Each stage reads what its predecessor wrote, works on all of it, and returns the columns of ``documents``; the
last returns its own. A stage's docstring says what it drops. Further columns are kept, whatever their names, up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import bpe, exact_dedup, langid, minhash, mixing
from strata.llm.common import free_names, id_remainder, prepare, read_table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects: null, empty and letterless ones, and those that no model explains.

    Rows are judged one by one, so repeated rows share their fate. A null id, lang or source matters only to training, where
    a null lang teaches nothing. Without any label all is rejected; an empty table stays empty.
    """
    prepare(spark)
    model = langid.train(docs, usable=id_remainder(F.col("doc_id"), 4) != 2)
    prefix = "_language_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return langid.identify(docs, model, prefix).where(~F.col(f"{prefix}rejected")).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the one with the largest id.

    Null and empty texts are equal; a null id is lower than all others. Of repeated rows (same id, same text) one stays; which, if their
    other columns differ, isn't defined. An empty table stays empty.
    """
    own, keep, sha = free_names(docs, "_own", "_id", "_sha")
    kept = exact_dedup.dedup(docs).where("kept").select(F.col("doc_id").alias(keep), F.unhex("text_sha256").alias(sha))
    rows = docs.withColumn(own, F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))).dropDuplicates(["doc_id", own])
    one = F.col("doc_id").eqNullSafe(F.col(keep)) & (F.col(own) == F.col(sha))
    return rows.join(written(kept, "kept"), one, "left_semi").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more), keeps the one with the smallest id.

    Texts without words are like nothing and stay, as do rows with a null id. All rows of a dropped id go. An empty table stays empty.
    """
    dropped = minhash.groups(docs).where("not kept").select("doc_id").distinct()
    return docs.join(written(dropped, "dropped"), "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Orders the documents by the Pfair schedule of their sources; drops none.

    A null source is a source of its own; rows of one id and source share a slot. An empty table stays empty.
    """
    prepare(spark)
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and mix_slot: the slot of the mixture that the document came in.

    The slot follows from the documents' ids and sources, so it is the mixture stage's, whatever order files are read in.
    One row per row; a null or empty text has no ids.
    """
    rows = mixing.slots(docs.select("doc_id", "source", "text"), mixing.plan(docs))
    return bpe.digests(rows, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id", "mix_slot"])


STAGES = [("language_id", language_id), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("token_ids", token_ids)]
#: Language models, near copies and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
