"""A table of literal patterns against lines."""

import random

from strata.operators import patterns as U
from strata.operators import rules as R
from strata.plans.q_rules import code_corpus, explode_rows


def brute(files, patterns):
    out = set()
    for i, lang, text in files:
        for n, line in enumerate((text or "").split("\n"), 1):
            out |= {(i, p, n, line.strip()) for p, of in patterns if p and "\n" not in p and of in (None, lang) and p in line}
    return out


def test_equals_searching_every_pattern(spark):
    rng = random.Random(1)
    files = [(i, rng.choice("ab"), "\n".join("".join(rng.choice("xyz (.é😀") for _ in range(rng.randint(0, 30))) for _ in range(6))) for i in range(40)]
    files += [(90, "a", None), (91, "b", ""), (92, "a", " \t\n\n"), (93, None, "x" * 50_000)]
    patterns = [("".join(rng.choice("xyz (.é😀") for _ in range(rng.randint(1, 7))), rng.choice([None, "a", "b"])) for _ in range(150)]
    patterns += [("", None), (None, None), ("x\ny", None), ("xxxx", None), ("xxxx", None), ("not there", None)]
    f = spark.createDataFrame(files, "id int, lang string, text string")
    p = spark.createDataFrame(patterns, "pattern string, language string")
    assert {tuple(r) for r in U.matches(f, "id", "text", p, "lang", language="language").collect()} == brute(files, patterns)
    assert {tuple(r) for r in U.matches(f, "id", "text", p).collect()} == brute(files, [(x, None) for x, _ in patterns])
    assert U.matches(f, "id", "text", p.where("false")).collect() == [] and U.matches(f.where("false"), "id", "text", p).collect() == []


def test_ten_thousand_patterns_cost_no_search_each(spark):
    p = spark.range(10_000).selectExpr("concat('call_', id, '(') AS pattern")
    f = spark.createDataFrame([(i, f"a\n  call_{i * 7}(x) + call_{i}(y)") for i in range(300)], "id int, text string")
    found = U.matches(f, "id", "text", p)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r.id, r.pattern) for r in found.collect()}
    assert got == {(i, f"call_{k}(") for i in range(300) for k in (i, i * 7)}


def test_gives_the_rows_of_the_fixed_patterns(spark):
    cc = code_corpus(spark, "/root/testdata/sf0.001")
    table = spark.createDataFrame([(lang, p) for lang, ps in R.patterns_by_lang().items() for p in ps], "language string, pattern string")
    hits = explode_rows(cc.withColumn("hits", R.pattern_hits("code", "lang")), ["file_id"], "hits", "h").select("file_id", "h.pattern", "h.line_no", "h.line_code")
    got = U.matches(cc, "file_id", "code", table, "lang", language="language")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in hits.collect()} != set()


def test_patterns_with_spaces_equal_searching_every_pattern(spark, monkeypatch):
    """They are looked up by pairs of words: no line is cut into q-grams for them."""
    rng = random.Random(2)
    words = ["", "a", "b", "ab", "aab", "abcab", "cabcab", "éa", "😀", "x\ta", "."]

    def some(n):
        return " ".join(rng.choice(words) for _ in range(n))
    files = [(rng.choice([i, i, 7, None]), rng.choice(["a", "b", None]), "\n".join(some(rng.randint(0, 12)) for _ in range(5))) for i in range(60)]
    files += [(7, "a", "a b"), (7, "a", "a b "), (7, "b", " a b"), (90, "a", None), (91, "b", " "), (92, "b", "  \n a \n")]
    patterns = [(some(rng.randint(2, 4)), rng.choice([None, "a", "b"])) for _ in range(120)]
    patterns += [(" ", None), ("  ", "a"), (" a", None), ("a ", "b"), ("b a b", None), ("b a b", "a"), ("not there", None), ("b x\ta", None)]
    f = spark.createDataFrame(files, "id int, lang string, text string")
    p = spark.createDataFrame(patterns, "pattern string, language string")
    monkeypatch.setattr(U, "_grams", None)
    for languages in (None, "language"):
        table = patterns if languages else [(x, None) for x, _ in patterns]
        got = [tuple(r) for r in U.matches(f, "id", "text", p, "lang" if languages else None, language=languages).collect()]
        assert set(got) == brute(files, [x for x in table if " " in x[0]]) and len(got) == len(set(got))
    once = f.where("id is not null").dropDuplicates(["id"])
    got = [tuple(r) for r in U.matches(once, "id", "text", p).collect()]
    assert set(got) == brute([tuple(r) for r in once.collect()], [(x, None) for x, _ in patterns if " " in x]) and len(got) == len(set(got))
