"""C4: recursive separator split (size 512, overlap 64, separators
``\\n\\n``, ``\\n``, ``;``) inside the row, as column expressions.

Spans first: whatever is longer than ``size`` is cut at the first separator, what
is still too long at the second one, and so on; a separator stays at the start of
the span that follows it. Then one fold merges neighbouring spans to pieces: a span
that would make the open piece longer than ``size`` closes it, and the next piece
starts with the earliest span of the closed one that leaves at most ``overlap``
characters repeated and room for the new span.

Contract (SURVEY N4): no piece is longer than ``size`` unless it holds no
separator left to split on; consecutive pieces overlap by at most ``overlap``
characters; the pieces cover the text in order. A null or empty text has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import SPLIT_OVERLAP, SPLIT_SEPARATORS, SPLIT_SIZE

#: Spans folded between two appends to the list of finished blocks, so that appending takes little time in long texts.
BLOCK_SPANS = 512
PIECES_TYPE = "array<struct<start:int,end:int,first:int,last:int>>"
RECENT_TYPE = "array<struct<o:int,i:int>>"


def _cut(span: Column, sep: str) -> Column:
    """The parts of a span; the separator at its very start doesn't count."""
    parts = F.split(F.substring(span, 2, 2**31 - 1), F.lit("\\Q" + sep + "\\E"), -1)
    return F.transform(parts, lambda p, i: F.concat(F.when(i == 0, F.left(span, F.lit(1))).otherwise(F.lit(sep)), p))


def _spans(text: Column, size: int, seps) -> Column:
    spans = F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    for sep in seps:
        spans = F.flatten(F.transform(spans, lambda s: F.when(F.length(s) > size, _cut(s, sep)).otherwise(F.array(s))))
    return spans


def _state(start, end, first, n, recent, pieces) -> Column:
    """The open piece's start, the end of the spans read, its first span, spans read, spans that may begin the next piece, and closed pieces."""
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), first.cast("int").alias("first"), n.cast("int").alias("n"),
                    recent.cast(RECENT_TYPE).alias("recent"), pieces.cast(PIECES_TYPE).alias("pieces"))


def _step(size: int, overlap: int):
    def step(acc, length):
        at, n = acc["end"], acc["n"]
        close = (at > acc["start"]) & (at - acc["start"] + length > size)
        # the spans of the closed piece that may be repeated begin at or behind this place
        room = at - F.least(F.lit(overlap), F.lit(size) - length)
        again = F.get(F.filter(acc["recent"], lambda r: r["o"] >= room), F.lit(0))
        here = F.struct(at.alias("o"), n.alias("i"))
        after = F.filter(F.concat(acc["recent"], F.array(here)), lambda r: r["o"] >= at + length - overlap)
        closed = F.struct(acc["start"].alias("start"), at.alias("end"), acc["first"].alias("first"), (n - 1).alias("last"))
        return _state(F.when(close, F.coalesce(again["o"], at)).otherwise(acc["start"]), at + length,
                      F.when(close, F.coalesce(again["i"], n)).otherwise(acc["first"]), n + 1, after,
                      F.when(close, F.concat(acc["pieces"], F.array(closed))).otherwise(acc["pieces"]))
    return step


def with_recursive_pieces(df: DataFrame, text: str, size: int = SPLIT_SIZE, overlap: int = SPLIT_OVERLAP,
                          seps=tuple(SPLIT_SEPARATORS), out: str = "pieces") -> DataFrame:
    """Adds array<struct<piece_no, start, end, text>>: places are in characters, the end is exclusive."""
    none = F.array().cast(PIECES_TYPE)
    zero = F.lit(0)
    d = df.withColumn("_sp", _spans(F.col(text), size, seps)).withColumn("_len", F.transform("_sp", lambda s: F.length(s)))
    blocks = F.transform(F.sequence(zero, F.floor((F.greatest(F.size("_len"), F.lit(1)) - 1) / BLOCK_SPANS).cast("int")),
                         lambda b: F.slice(F.col("_len"), b * BLOCK_SPANS + 1, F.lit(BLOCK_SPANS)))
    step = _step(size, overlap)

    def fold_block(acc, lengths):
        s, a = F.aggregate(lengths, _state(*[acc["s"][c] for c in ("start", "end", "first", "n", "recent")], none), step), acc["done"]
        return F.transform(F.array(s), lambda x: F.struct(x.alias("s"), F.concat(a, F.array(x["pieces"])).alias("done")))[0]

    start = F.struct(_state(zero, zero, zero, zero, F.array(), none).alias("s"), F.array().cast(f"array<{PIECES_TYPE}>").alias("done"))
    d = d.withColumn("_blocks", blocks).withColumn("_end", F.aggregate("_blocks", start, fold_block))
    s = F.col("_end.s")
    rest = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["first"].alias("first"), (s["n"] - 1).alias("last"))
    d = d.withColumn("_pc", F.when(s["n"] > 0, F.concat(F.flatten(F.col("_end.done")), F.array(rest))).otherwise(none))
    return d.withColumn(out, F.transform("_pc", lambda p, i: F.struct(
        i.alias("piece_no"), p["start"].alias("start"), p["end"].alias("end"),
        F.array_join(F.slice(F.col("_sp"), p["first"] + 1, p["last"] - p["first"] + 1), "").alias("text")))
    ).drop("_sp", "_len", "_blocks", "_end", "_pc")
