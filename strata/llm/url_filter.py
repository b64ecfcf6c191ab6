"""URL verdicts from rules and a list, by a blocked Bloom filter and an exact hash join.

Every entry, rule or listed, is a canonical URL: a host and the start of a path. It
fits its host and all subdomains. The entries fill a blocked Bloom filter: a key's
hash picks one 64-bit word, four more hash pieces pick bits within it, so a probe reads one
word. The filter is a table (block, word), made by one aggregation.

Each distinct URL (host, path) gives one probe per number of host labels and per path
length that an entry has. Probes that the filter passes go to the exact join on (host,
path), which removes false positives. The longest rule that fits decides; without
one, a URL with a listed entry is blocked and any other is allowed.

Filter and entries are broadcast only if their counted rows are below a bound;
beyond it both joins shuffle, and skewed keys are split by adaptive execution.

Defined results: a null URL, or one without "://", has empty host and path and is
allowed. Only A-Z are lower-cased. Equal rows all get the verdict. Other columns
of the table play no part. Of rules of equal length the later in text order decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rows a filter or a set of entries is broadcast (some ten MB).
BROADCAST_ROWS = 200_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(key: Column) -> Column:
    """Four bits of a 64-bit word."""
    h = F.xxhash64(key, F.lit(2))
    mask = F.lit(0).cast("bigint")
    for i in range(4):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter (block, word) of column ``key``."""
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_bits(F.col("key"))).alias("word"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def judge(pages: DataFrame, entries: DataFrame, keys_per_block: int = 4) -> DataFrame:
    """page_id, host, path, rule, listed, verdict for every row of ``pages`` (page_id, url).

    entries: host, path, verdict (allow or block), listed (true: blocked unless a rule says otherwise).
    """
    entries = written(entries.select("host", "path", "verdict", "listed", F.concat("host", "path").alias("rule")).distinct(), "url-entries")
    count = entries.count()
    lengths = [r["n"] for r in entries.select(F.length("path").alias("n")).distinct().collect()]  # numbers up to a URL's length
    depths = [r["n"] for r in entries.select(F.size(F.split("host", "\\.", -1)).alias("n")).distinct().collect()]  # likewise, of labels
    blocks = max(1, -(-count // keys_per_block))

    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = rows.where("host <> ''").select("host", "path").distinct()
    labels = F.split("host", "\\.", -1)
    ends = [F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in sorted(depths)]
    suffixes = F.array_compact(F.array(*ends)) if ends else F.array().cast("array<string>")
    probes = urls.select("host", "path", F.explode(suffixes).alias("e_host"))
    starts = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths)]) if lengths else F.array().cast("array<string>")
    probes = probes.select("host", "path", "e_host", F.explode(F.array_compact(starts)).alias("e_path"))
    probes = probes.withColumns({"key": F.concat("e_host", F.lit("\n"), "e_path")})
    words = written(bloom(entries.select(F.concat("host", F.lit("\n"), "path").alias("key")), blocks), "url-bloom")
    possible = (probes.withColumns({"block": _block(F.col("key"), blocks), "bits": _bits(F.col("key"))})
                .join(_small(words, blocks), "block").where(F.col("word").bitwiseAND(F.col("bits")) == F.col("bits"))
                .select("host", "path", "e_host", "e_path"))
    exact = entries.select(F.col("host").alias("e_host"), F.col("path").alias("e_path"), "rule", "listed", F.col("verdict").alias("said"))
    hits = possible.join(_small(exact, count), ["e_host", "e_path"])
    best = written(hits.groupBy("host", "path").agg(
        F.max(F.when(~F.col("listed"), F.struct(F.length("rule").alias("n"), "rule", "said"))).alias("best"),
        F.bool_or("listed").alias("listed")), "url-best")
    return (rows.join(best.hint("merge"), ["host", "path"], "left")
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("listed", F.lit(False)).alias("listed"),
                    F.coalesce("best.said", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict")))
