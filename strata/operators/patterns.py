"""Matching a table of literal patterns, given by the user, against the lines of files.

Patterns with a space are looked up by pairs of neighbouring words, words being what spaces part. Inside a pattern, what
stands beside a space is the end of a line's word, its beginning, or, between two spaces, the whole word:

1. the distinct pairs of words of the lines are counted;
2. each pair meets the pairs of the patterns by an equi-join on the ``EDGE`` characters on both sides of the space;
3. each pattern is indexed under the pairs that fit the space of which the fewest lines hold one;
4. lines' pairs, without the lines, meet the index by an equi-join; lines join what they may hold, and ``contains`` decides.

So a line's text is in no more rows than it has matches, and it isn't cut into characters.

Other patterns: a pattern can only stand in a line that holds each of its q-grams (runs of ``Q``
characters; a shorter pattern is one gram of its own length). So a pattern is
looked up by the one of its grams that the fewest lines hold:

1. the lines' distinct grams that occur in any pattern are counted;
2. each pattern is indexed under its rarest gram (ties: the smaller gram);
3. lines meet patterns by an equi-join on that gram, and ``contains`` decides.

So thousands of patterns cost one hash lookup per distinct gram of a line, not
thousands of searches. Patterns of which some gram occurs in no line drop out at
step 2. The pattern side is as large as the user's table; Spark broadcasts it
while it is under the broadcast threshold and else joins by shuffle.

A null or empty pattern matches nothing; a pattern holds no line feed (one that
does matches nothing); a pattern given twice counts once. A null text has no
lines. A null language of a pattern means every language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lines import explode_rows, lines_l2, py_strip
from ..session import scratch_path

Q = 4
#: Characters beside a space that pairs of words are compared by.
EDGE = 3


def _grams(chars: str, n: int) -> Column:
    """The distinct runs of n of the characters in a column (an array: to cut a long string at every place costs its length each time)."""
    starts = F.slice(chars, 1, F.greatest(F.size(chars) - (n - 1), F.lit(0)))
    return F.array_distinct(F.transform(starts, lambda c, i: F.concat(c, *[F.get(chars, i + k) for k in range(1, n)])))


def _written(df: DataFrame, name: str) -> DataFrame:
    """Written in the shared folder and read again: Spark knows its size when it plans the join with the lines."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _lines(files: DataFrame, id_col: str, text: str, lang: str | None) -> DataFrame:
    lines = F.transform(lines_l2(text), lambda l, i: F.struct((i + 1).alias("line_no"), l.alias("line")))
    d = files.select(id_col, (F.col(lang) if lang else F.lit(None).cast("string")).alias("_lang"), lines.alias("_l"))
    lines = explode_rows(d, [id_col, "_lang"], "_l", "x").select(id_col, "_lang", "x.line_no", "x.line").where("line <> ''")
    return lines.withColumn("_c", F.split("line", ""))


def matches(files: DataFrame, id_col: str, text: str, patterns: DataFrame, lang: str | None = None, pattern: str = "pattern",
            language: str | None = None) -> DataFrame:
    """(id, pattern, line_no, line_code) for every pattern and line that holds it; with ``lang`` and ``language`` of equal
    languages only. line_code is stripped. patterns: a table with the column ``pattern``, perhaps ``language``."""
    p = patterns.select(F.col(pattern).alias("pattern"), (F.col(language) if language and lang else F.lit(None).cast("string")).alias("language"))
    p = p.where("pattern <> '' and not contains(pattern, '\n')").distinct()
    spaced, p = p.where(F.contains("pattern", F.lit(" "))), p.where(~F.contains("pattern", F.lit(" ")))
    if not spaced.isEmpty():
        found = _by_pair(files, id_col, text, spaced, lang)
        return found if p.isEmpty() else found.unionByName(_by_gram(files, id_col, text, p, lang))
    return _by_gram(files, id_col, text, p, lang)


def _by_gram(files: DataFrame, id_col: str, text: str, p: DataFrame, lang: str | None) -> DataFrame:
    """The matches of any patterns (pattern, language), distinct ones."""
    # gram lengths in use: Q at most
    sizes = sorted(r[0] for r in p.select(F.least(F.length("pattern"), F.lit(Q)).alias("n")).distinct().collect())
    if not sizes:
        return _lines(files, id_col, text, lang).select(id_col, F.lit("").alias("pattern"), "line_no", py_strip("line").alias("line_code")).where("false")
    p = p.withColumn("_c", F.split("pattern", ""))
    grams = F.lit(None).cast("array<string>")
    for n in sizes:
        grams = F.when(F.least(F.size("_c"), F.lit(Q)) == n, _grams("_c", n)).otherwise(grams)
    of_pattern = _written(explode_rows(p.withColumn("_g", grams), ["pattern", "language"], "_g", "gram"), "pattern-grams")
    lines = _lines(files, id_col, text, lang).withColumn("_g", F.concat(*[_grams("_c", n) for n in sizes]))
    seen = explode_rows(lines, [], "_g", "gram").join(of_pattern.select("gram").distinct(), "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    by_gram = of_pattern.join(seen, "gram", "left").groupBy("pattern", "language").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    index = _written(by_gram.where("rarest.n > 0").select("pattern", "language", F.col("rarest.gram").alias("gram")), "pattern-index")
    found = explode_rows(lines, [id_col, "_lang", "line_no", "line"], "_g", "gram").join(index, "gram")
    same = F.col("language").isNull() | (F.col("language") == F.col("_lang"))
    return (found.where(same & F.contains("line", "pattern"))
            .select(id_col, "pattern", F.col("line_no").cast("int").alias("line_no"), py_strip("line").alias("line_code")).distinct())


def _beside_spaces(words: str) -> Column:
    """Of an array of words, neighbours that aren't the first or last word whole."""
    def pair(left, i):
        last = F.size(words) - 1
        return F.struct(i.alias("i"), left.alias("left"), F.get(words, i + 1).alias("right"), (i == 0).alias("ends"), (i + 1 == last).alias("begins"))
    return F.transform(F.slice(words, 1, F.size(words) - 1), pair)


def _by_pair(files: DataFrame, id_col: str, text: str, p: DataFrame, lang: str | None) -> DataFrame:
    """The matches of patterns (pattern, language) that hold a space."""
    edge = F.concat(F.right("left", F.lit(EDGE)), F.lit(" "), F.left("right", F.lit(EDGE)))
    of_pattern = p.groupBy("pattern").agg(F.max(F.col("language").isNull()).alias("_every"), F.collect_set("language").alias("languages"))
    of_pattern = of_pattern.select("pattern", F.when(~F.col("_every"), F.col("languages")).alias("languages")).withColumn("_w", F.split("pattern", " "))
    of_pattern = explode_rows(of_pattern.withColumn("_x", _beside_spaces("_w")), ["pattern", "languages", F.size("_w").alias("words")], "_x", "x")
    of_pattern = _written(of_pattern.select("pattern", "languages", "words", "x.*").withColumn("edge", edge), "pattern-pairs")
    shapes = of_pattern.select(F.least(F.length("left"), F.lit(EDGE)).alias("a"), F.least(F.length("right"), F.lit(EDGE)).alias("b")).distinct().collect()  # few

    lines = _lines(files, id_col, text, lang).drop("_c")
    of_line = lines.where(F.contains("line", F.lit(" "))).withColumn("_w", F.split("line", " "))
    neighbours = F.transform(F.slice("_w", 1, F.size("_w") - 1), lambda w, i: F.concat(w, F.lit(" "), F.get("_w", i + 1)))
    of_line = of_line.withColumn("_p", F.array_distinct(neighbours))
    seen = explode_rows(of_line, [], "_p", "pair").groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    word, after = F.substring_index("pair", " ", 1), F.substring_index("pair", " ", -1)
    edges = [F.when((F.length("word") >= r["a"]) & (F.length("after") >= r["b"]),
                    F.concat(F.right("word", F.lit(r["a"])), F.lit(" "), F.left("after", F.lit(r["b"])))) for r in shapes]
    seen = seen.withColumns({"word": word, "after": after}).withColumn("_e", F.array(*edges))
    fits = (F.when(F.col("ends"), F.endswith("word", "left")).otherwise(F.col("word") == F.col("left"))
            & F.when(F.col("begins"), F.startswith("after", "right")).otherwise(F.col("after") == F.col("right")))
    fitting = explode_rows(seen, ["pair", "n", "word", "after"], "_e", "edge").join(of_pattern, "edge").where(fits)
    fitting = _written(fitting.select("pattern", "languages", "words", "i", "pair", "n"), "pattern-fits")
    lines_of = fitting.groupBy("pattern", "words", "i").agg(F.sum("n").alias("n"))
    rarest = (lines_of.groupBy("pattern", "words").agg(F.min(F.struct("n", "i")).alias("r"), F.count(F.lit(1)).alias("spaces"))
              .where("spaces = words - 1").select("pattern", F.col("r.i").alias("i")))
    index = _written(fitting.join(rarest, ["pattern", "i"]).select("pair", "pattern", "languages"), "pattern-index")

    maybe = explode_rows(of_line, [id_col, "_lang", "line_no"], "_p", "pair").join(index, "pair")
    maybe = maybe.where(F.col("languages").isNull() | F.array_contains("languages", F.col("_lang")))
    maybe = maybe.select(F.col(id_col).alias("_id"), F.col("_lang").alias("_of"), F.col("line_no").alias("_no"), "pattern").distinct()
    same = F.col(id_col).eqNullSafe(F.col("_id")) & F.col("_lang").eqNullSafe(F.col("_of")) & (F.col("line_no") == F.col("_no"))
    found = lines.hint("merge").join(maybe.hint("merge"), same).where(F.contains("line", "pattern"))
    found = found.select(id_col, "pattern", F.col("line_no").cast("int").alias("line_no"), py_strip("line").alias("line_code"))
    # only rows of one id can give a match twice
    return found if files.groupBy(id_col).count().where("count > 1").isEmpty() else found.distinct()
