"""Quality rules whose cutoffs are chosen by risk control. DataFrame functions only.

A rule rejects a document if a ratio of its text is above a cutoff. For each
stratum (language) and rule, labelled documents tell how many good and bad ones each cutoff of a fixed
grid rejects. A cutoff is admitted if the share of good documents that it rejects
is at most ``risk / rules`` with certainty: the exact binomial (Clopper-Pearson)
upper bound at level ``error / tests``, where ``tests`` counts all strata, rules and
cutoffs (Bonferroni). So with probability 1 - ``error`` all admitted cutoffs keep
their promise together, and a stratum loses at most ``risk`` of its good documents to all
rules. Of the admitted cutoffs, the one that rejects the most bad documents, less
``PRICE`` for each good one, is used, the highest such. Where the labels are too few to admit any, the rule is off.

Words are runs of characters other than ASCII white space.

Defined results: null text has no words; its counts are 0 and it fails the base rule. A null
and an empty language are one stratum. Labels other than 0 and 1 teach nothing; a
repeated label counts as often as it occurs. Rows are kept as they come; other columns
play no part. Without labels only the base rule rejects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Ratios that the rules limit, as SQL over the counts.
RATIOS = {
    "symbols": "n_symbols / n_words",
    "dup_lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words",
    "upper": "n_upper / word_chars",
    "bangs": "n_bangs / n_words",
    "word_length": "word_chars / n_words / 20",
}
PRICE = 20
CUTOFFS = [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.5, 2.0]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words in windows of three words that the text holds twice or more."""
    n = F.size(words)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])))

    def places(sorted_windows: Column) -> Column:
        last = F.size(sorted_windows)
        twice = F.filter(sorted_windows, lambda s, k: ((k > 0) & (F.get(sorted_windows, k - 1)["h"] == s["h"]))
                         | ((k + 1 < last) & (F.get(sorted_windows, k + 1)["h"] == s["h"])))
        return F.sort_array(F.transform(twice, lambda s: s["i"]))

    def covered(at: Column) -> Column:
        # each window adds the words that the window before it doesn't hold
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(at, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
                           lambda acc: acc["n"])

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(let(pairs, places)))

    return F.coalesce(let(windows, count), F.lit(0).cast("bigint"))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts of every row of ``docs`` (doc_id, lang, text)."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, ASCII_SPACE, "") != ""))
    long = lambda c: c.cast("bigint")
    size = F.length("text")
    return rows.select(
        "doc_id", "stratum", long(F.size("words")).alias("n_words"),
        long(_without(F.col("text"), ASCII_SPACE)).alias("word_chars"),
        long(size - _without(F.col("text"), SYMBOLS)).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        long(size - _without(F.col("text"), UPPER)).alias("n_upper"),
        long(size - _without(F.col("text"), "!")).alias("n_bangs"))


def binomial_below(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), summed in logarithms."""
    odds = F.lit(p / (1 - p))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("log"), F.exp(n * F.log(F.lit(1 - p))).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log((n - i + 1) / i * odds)
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    return F.aggregate(F.filter(F.sequence(F.lit(0).cast("bigint"), k), lambda i: i > 0), start, add, lambda acc: acc["sum"])


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """stratum, rule, cutoff: the admitted cutoffs in use. labels: doc_id, label (1 is good)."""
    grid = F.array(*[F.lit(c) for c in CUTOFFS])
    known = measured.join(labels.where("label in (0, 1)"), "doc_id")
    values = F.array(*[F.struct(F.lit(rule).alias("rule"), F.coalesce(F.expr(f"try_divide({a}, {b})"), F.lit(0.0)).alias("value"))
                       for rule, (a, b) in ((r, e.split(" / ", 1)) for r, e in _ratios().items())])
    rows = known.select("stratum", "label", F.explode(values).alias("v"))
    # how many cutoffs a value is above: one small histogram per stratum and rule
    step = F.size(F.filter(grid, lambda c: c < F.col("v.value")))
    bins = rows.groupBy("stratum", F.col("v.rule").alias("rule"), step.alias("step")).agg(
        F.sum("label").cast("bigint").alias("good"), F.sum(1 - F.col("label")).cast("bigint").alias("bad"))
    tests = bins.groupBy("stratum", "rule").agg(
        F.sum("good").alias("n_good"), F.collect_list(F.struct("step", "good", "bad")).alias("bins"))  # a bin per cutoff and one more
    above = lambda what: lambda acc, b: acc + F.when(b["step"] > F.col("number"), b[what]).otherwise(F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    tests = tests.select("stratum", "rule", "n_good", "bins", F.posexplode(grid).alias("number", "cutoff")).select(
        "stratum", "rule", "n_good", "cutoff", F.aggregate("bins", zero, above("good")).alias("lost"), F.aggregate("bins", zero, above("bad")).alias("caught"))
    tests = written(tests, "rule-tests")
    share = risk / len(RATIOS)
    level = error / max(1, tests.count())
    admitted = tests.where(F.when(F.col("lost") < share * F.col("n_good"), binomial_below(F.col("lost"), F.col("n_good"), share) <= level).otherwise(False))
    gain = F.col("caught") - PRICE * F.col("lost")
    best = F.max(F.struct(gain, "cutoff"))
    return admitted.where(gain > 0).groupBy("stratum", "rule").agg(best.alias("b")).select("stratum", "rule", F.col("b.cutoff").alias("cutoff"))


def _ratios() -> dict[str, str]:
    """The ratios with one division each (a constant divisor goes into the denominator)."""
    return {r: (e if e.count("/") == 1 else "{} / ({} * {})".format(*e.split(" / "))) for r, e in RATIOS.items()}


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """doc_id, the counts, base_failed, rejected_by (names of rules) and kept for every row of ``docs`` (doc_id, lang, text)."""
    measured = written(counts(docs), "rule-counts")
    used = written(cutoffs(measured, labels, risk, error), "rule-cutoffs")
    wide = used.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RATIOS])
    rows = measured.join(wide, "stratum", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    names = F.array_compact(F.array(*[F.when(F.expr("try_divide({}, {})".format(*e.split(" / ", 1))) > F.col(f"cut_{r}"), F.lit(r))
                                      for r, e in _ratios().items()]))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                       F.array_join(names, ",").alias("rejected_by"), (~failed & (F.size(names) == 0)).alias("kept"))
