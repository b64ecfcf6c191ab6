"""Figures FIXTURES.md states for sf0.01, reproduced exactly."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_fallback_chunk_counts(spark, catalog):
    fb = catalog.QUERIES["chunk_fallback"](spark, SF)
    per_doc = dict(tuple(r) for r in fb.filter("src = 'doc'").groupBy("id").count().groupBy("count").count().collect())
    assert per_doc == {1: 990, 2: 9, 3: 1}
    assert fb.filter("src = 'page'").groupBy("id").count().filter("count <> 1").count() == 0
    code = fb.filter("src = 'code' AND id IN (3, 4, 5)").orderBy("id", "chunk_no")
    assert [(r.id, r.start_line, r.end_line, r.n_lines) for r in code.collect()] == [
        (3, 1, 7, 5), (3, 8, 9, 2), (4, 1, 6, 6), (4, 7, 8, 2), (5, 1, 3, 3), (5, 4, 4, 1)]


def test_definition_blocks(spark, catalog):
    b = catalog.QUERIES["chunk_blocks"](spark, SF).filter(F.col("file_id").isin(3, 4, 5)).orderBy("file_id", "chunk_no")
    assert [(r.file_id, r.start_line, r.end_line) for r in b.collect()] == [
        (3, 3, 5), (3, 7, 9), (4, 2, 8), (5, 1, 3), (5, 4, 4)]


def test_language_guess(spark, catalog):
    g = catalog.QUERIES["lang_by_content"](spark, SF)
    assert g.filter("lang = guess").count() == 951 and g.filter("guess IS NULL").count() == 16
    top = g.filter("lang <> guess").groupBy("lang", "guess").count().orderBy(F.desc("count")).first()
    assert (top.lang, top.guess, top["count"]) == ("fr", "es", 28)


def test_rule_and_copy_counts(spark, catalog):
    rf = catalog.QUERIES["rule_findings"](spark, SF).filter("src = 'doc'")
    per_rule = dict(tuple(r) for r in rf.groupBy("check_id").agg(F.countDistinct("id")).collect())
    assert per_rule == {"secret-assignment": 12, "email-address": 11, "ipv4-address": 25, "license-line": 39}
    assert catalog.QUERIES["dedupe_work"](spark, SF).filter("doc_id <> rep_id").count() == 73
    assert catalog.QUERIES["ttl_dedupe"](spark, SF).count() == 6930
