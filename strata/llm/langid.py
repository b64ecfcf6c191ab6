"""Language identification with interpolated Kneser-Ney character models.

One character model per language, all of the same order. The n-grams of all
languages of one length share one sorted array of 64-bit hashes; beside it lie
the log-probabilities and back-off weights, a column per language. A text gets
the language with the lowest cross-entropy per character. A limit per language,
calibrated on labelled texts that the counts haven't seen, rejects texts that
no model explains.

Texts are lower-cased; every run of characters that aren't letters is one space.

Defined results: a null or letterless text gets ``und``, score 0, rejected. With
no usable label at all, every text is ``und``. Rows are kept as they come, also
repeated ones; columns beside ``text`` play no part. Of languages with equal
cross-entropy the first in alphabetical order wins.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, prepare, text_blocks, written

UNDETERMINED = "und"
START = 0  # stands before the first character of a text
SPACE = 32
#: Rows of each language that count, and as many that calibrate, if it has them.
LEAST_ROWS = 20
#: Odd multipliers of the places in an n-gram, from a fixed seed.
PLACES = np.random.default_rng(20240101).integers(1 << 62, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or a space for all else."""
    lut = np.full(0x110000, SPACE, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            lut[c] = ord(low) if len(low) == 1 else c
    return lut


def normalised(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ``order - 1`` START marks, and where each text begins."""
    lut, parts, starts, at = _letters(), [], [], 0
    lead = np.zeros(order - 1, dtype=np.uint32)
    for t in texts:
        c = lut[np.frombuffer(t.encode("utf-32-le", "replace"), dtype=np.uint32)]
        if len(c):
            keep = c != SPACE
            keep[1:] |= c[:-1] != SPACE
            c = c[keep]
        starts.append(at)
        parts += [lead, c]
        at += len(lead) + len(c)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.array(starts, dtype=np.int64)


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """[k - 1][i]: hash of the k-gram that ends at place i."""
    wide, out, total = codes.astype(np.uint64) + np.uint64(1), [], np.zeros(len(codes), np.uint64)
    for k in range(order):
        part = wide * PLACES[k]
        total = total.copy()
        if k:
            total[k:] += part[:-k]
        else:
            total += part
        out.append(mix64(total))
    return out


class HashRows:
    """Sorted array of hashes with a directory over their leading bits."""

    def __init__(self, keys: np.ndarray):
        """keys: sorted and distinct."""
        bits = max(1, int(np.ceil(np.log2(len(keys) + 1))) + 1)
        self.shift = np.uint64(64 - bits)
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        edges = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.first = np.searchsorted(keys, edges).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        at = self.first[(h >> self.shift).astype(np.int64)]
        low = np.flatnonzero(self.keys[at] < h)
        while len(low):
            at[low] += 1
            low = low[self.keys[at[low]] < h[low]]
        at[self.keys[at] != h] = -1
        at[at == len(self.keys) - 1] = -1
        return at


@dataclass
class Model:
    languages: list[str]
    order: int
    rows: list[HashRows] = field(default_factory=list)      # by length of the n-gram
    logp: list[np.ndarray] = field(default_factory=list)    # of the n-gram's last character
    backoff: list[np.ndarray] = field(default_factory=list)  # of the n-gram as a context
    unseen: np.ndarray | None = None                        # log-probability of an unknown character
    limits: dict[str, float] = field(default_factory=dict)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per character (text, language), characters scored, and whether a text has a letter."""
        codes, starts = normalised(texts, self.order)
        n_lang = len(self.languages)
        total, count = np.zeros((len(texts), n_lang)), np.zeros(len(texts), dtype=np.int64)
        letters = np.zeros(len(texts), dtype=bool)
        if not len(codes):
            return total, count, letters
        ends = np.append(starts[1:], len(codes))
        step, back = 1 << 20, self.order - 1
        for lo in range(0, len(codes), step):  # bounded memory for one very long text
            part = codes[max(0, lo - back):lo + step]
            skip = lo - max(0, lo - back)
            logp = self._score(part)[skip:]
            real = part[skip:] != START
            logp[~real] = 0
            is_letter = real & (part[skip:] != SPACE)
            first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, lo + len(logp), "left")
            at = np.maximum(starts[first:last] - lo, 0)
            total[first:last] += np.add.reduceat(logp, at, axis=0, dtype=np.float64)
            count[first:last] += np.add.reduceat(real.astype(np.int64), at)
            letters[first:last] |= np.add.reduceat(is_letter.astype(np.int64), at) > 0
        return -total / np.maximum(count, 1)[:, None], count, letters

    def _score(self, codes: np.ndarray) -> np.ndarray:
        hashes = gram_hashes(codes, self.order)
        out = np.zeros((len(codes), len(self.languages)), dtype=np.float32)
        rest = np.arange(len(codes))
        for k in range(self.order, 0, -1):
            row = self.rows[k - 1].find(hashes[k - 1][rest])
            hit = row >= 0
            out[rest[hit]] += self.logp[k - 1][row[hit]]
            rest = rest[~hit]
            if k > 1 and len(rest):
                ctx = self.rows[k - 2].find(hashes[k - 2][np.maximum(rest - 1, 0)])
                known = (ctx >= 0) & (rest > 0)
                out[rest[known]] += self.backoff[k - 2][ctx[known]]
        out[rest] += self.unseen
        return out


def build(counts: dict[str, Counter], order: int) -> Model:
    """Model of the counts of ``order``-grams (strings) per language."""
    langs = sorted(counts)
    model = Model(langs, order)
    per_order: list[dict[str, dict[str, float]]] = [{} for _ in range(order)]  # n-gram -> language -> probability
    contexts: list[dict[str, dict[str, float]]] = [{} for _ in range(order)]   # context -> language -> weight
    unseen = []
    for lang in langs:
        # highest order: counts; below: number of distinct characters seen before
        levels: list[Counter] = [Counter() for _ in range(order)]
        levels[order - 1] = counts[lang]
        for k in range(order - 1, 0, -1):
            lower = levels[k - 1]
            for g in levels[k]:
                lower[g[1:]] += 1
        probs: list[dict[str, float]] = [{} for _ in range(order)]
        weights: list[dict[str, float]] = [{} for _ in range(order)]
        symbols = len(levels[0]) + 1
        for k in range(1, order + 1):
            level = levels[k - 1]
            n1 = sum(1 for v in level.values() if v == 1)
            n2 = sum(1 for v in level.values() if v == 2)
            d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
            sums, kinds = Counter(), Counter()
            for g, c in level.items():
                sums[g[:-1]] += c
                kinds[g[:-1]] += 1
            for ctx, s in sums.items():
                weights[k - 1][ctx] = d * kinds[ctx] / s
            for g, c in level.items():
                lower = probs[k - 2][g[1:]] if k > 1 else 1 / symbols
                probs[k - 1][g] = (c - d) / sums[g[:-1]] + weights[k - 1][g[:-1]] * lower
        model.limits[lang] = float(np.log(symbols))  # guessing evenly among the known characters explains nothing
        unseen.append(np.log(weights[0].get("", 1.0) / symbols))
        for k in range(order):
            for g, p in probs[k].items():
                per_order[k].setdefault(g, {})[lang] = p
            for ctx, w in weights[k].items():
                contexts[k].setdefault(ctx, {})[lang] = w
    model.unseen = np.array(unseen, dtype=np.float32)

    for k in range(order - 1):
        for ctx in contexts[k + 1]:  # a context of START marks alone ends no n-gram, yet has a weight
            per_order[k].setdefault(ctx, {})
    lp: list[dict[str, np.ndarray]] = []
    for k in range(order):
        table = {}
        for g in per_order[k]:
            row = np.empty(len(langs), dtype=np.float32)
            seen, ctx = per_order[k][g], contexts[k].get(g[:-1], {})
            lower = lp[k - 1].get(g[1:]) if k else None
            for j, lang in enumerate(langs):
                if lang in seen:
                    row[j] = np.log(seen[lang])
                else:
                    row[j] = (model.unseen[j] if lower is None else lower[j]) + (np.log(ctx[lang]) if lang in ctx and k else 0.0)
            table[g] = row
        lp.append(table)
    for k in range(order):
        grams = sorted(lp[k])
        hashes = np.zeros(len(grams), dtype=np.uint64)
        if grams:
            codes = np.frombuffer("".join(grams).encode("utf-32-le"), dtype=np.uint32)
            hashes = gram_hashes(codes, k + 1)[k][k::k + 1]
        by = np.argsort(hashes)
        back = np.zeros((len(grams), len(langs)), dtype=np.float32)
        if k + 1 < order:
            for i, g in enumerate(grams):
                for j, lang in enumerate(langs):
                    w = contexts[k + 1].get(g, {}).get(lang)
                    if w:
                        back[i, j] = np.log(w)
        model.rows.append(HashRows(hashes[by]))
        model.logp.append(np.array([lp[k][g] for g in grams], dtype=np.float32).reshape(len(grams), len(langs))[by])
        model.backoff.append(back[by])
    return model


def _count(order: int):
    def count(batches):
        for batch, texts in text_blocks(batches):
            found: dict[str, Counter] = {}
            for lang, t in zip(batch.column("lang").to_pylist(), texts):
                codes, _ = normalised([t], order)
                s = codes.astype(np.uint32).tobytes().decode("utf-32-le")
                found.setdefault(lang, Counter()).update(s[i:i + order] for i in range(len(s) - order + 1))
            yield pa.RecordBatch.from_pylist(
                [{"lang": lang, "gram": g, "n": n} for lang, c in found.items() for g, n in c.items()],
                schema=pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())]))
    return count


def _entropy_rows(shared, prefix: str = ""):
    def score(batches):
        model = shared.value
        for batch, texts in text_blocks(batches):
            h, n, letters = model.entropies(texts)
            best = h.argmin(axis=1)
            gaps = -(h - h.min(axis=1, keepdims=True)) * np.minimum(n, 100)[:, None]
            share = 1 / np.exp(gaps).sum(axis=1)
            lang = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters)]
            low = h[np.arange(len(best)), best]
            limit = np.array([model.limits.get(x, np.inf) for x in lang]) + 4 / np.sqrt(np.maximum(n, 1))
            cols = {"lang_pred": pa.array(lang, pa.string()),
                    "score": pa.array(np.where(letters, share, 0.0), pa.float64()),
                    "cross_entropy": pa.array(np.where(letters, low, np.nan), pa.float64()),
                    "rejected": pa.array(~letters | (low > limit), pa.bool_())}
            cols = {prefix + name: col for name, col in cols.items()}
            for name in cols:
                i = batch.schema.get_field_index(name)
                if i >= 0:
                    batch = batch.remove_column(i)
            for name, col in cols.items():
                batch = batch.append_column(name, col)
            yield batch
    return score


RESULT = "lang_pred string, score double, cross_entropy double, rejected boolean"


def draw(rows: DataFrame, chars: int) -> DataFrame | None:
    """The rows (lang, text, counts) that count and that calibrate, of ``rows`` (lang, text, key); None if no text has a letter.

    Only rows below a threshold of their language are ranked: the place in [0, 1) where the running sum of characters,
    by sixteenths of an octave, has reached what both kinds need."""
    place = (F.shiftrightunsigned(F.xxhash64("key", "text", F.lit(1)), 11) + 1) / F.lit(float(1 << 53))
    rows = rows.where(F.col("text").rlike(r"\p{L}")).withColumn("u", place).withColumn("level", F.floor(F.log2("u") * 16).cast("int"))
    names = [r["lang"] for r in rows.select("lang").distinct().collect()]  # the share depends on their number
    if not names:
        return None
    share = chars / len(names)
    rows = rows.withColumn("weight", F.least(F.length("text").cast("double"), F.lit(share / LEAST_ROWS)))
    found: dict[str, list] = {}
    for r in rows.groupBy("lang", "level").agg(F.sum("weight").alias("weight")).collect():
        found.setdefault(r["lang"], []).append((r["level"], r["weight"]))
    last = {}
    for lang, levels in found.items():
        total = 0.0
        for last[lang], weight in sorted(levels):
            total += weight
            if total >= 3 * share:  # two shares, and one as rows of unequal length fall by turns
                break
    bound = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
    rows = rows.where(F.col("level") <= F.element_at(bound, F.col("lang")))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("u", "key")) % 2 == 1
    rows = rows.withColumn("counts", turn)
    before = F.sum("weight").over(Window.partitionBy("lang", "counts").orderBy("u", "key").rowsBetween(Window.unboundedPreceding, -1))
    return written(rows.withColumn("before", F.coalesce(before, F.lit(0.0))).where(F.col("before") < share)
                   .select("lang", "text", "counts"), "language-sample")


def train(docs: DataFrame, label: str = "lang", usable: Column | None = None, order: int = 4,
          train_chars: int = 1_200_000, margin: float = 8.0, key: str = "doc_id") -> Model:
    """Fit the models and their limits of rejection.

    ``docs`` needs ``text``, ``label`` and ``key``. ``train_chars`` is the documented bound: about so many
    characters, shared by the languages, are counted, and about as many calibrate. The rows of a language are drawn
    whole, in the order of a hash, by turns to count and to calibrate, until its share is met; a row counts for at most
    a LEAST_ROWS-th of the share, so each language has that many rows of either kind, or all it has, however
    long its texts are. The model's size follows that bound, not the input, so it may be broadcast.
    A text is rejected if its cross-entropy exceeds the median of correctly labelled calibration texts by more
    than ``margin`` times the distance from there to their 99th percentile, or reaches that of even guessing, plus 4 / sqrt(characters) nats.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull() & (usable if usable is not None else F.lit(True)))
    drawn = draw(rows.select(F.col(label).alias("lang"), "text", F.col(key).alias("key")), train_chars)
    if drawn is None:
        return Model([], order)
    grams = (drawn.where("counts").select("lang", "text")
             .mapInArrow(_count(order), "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    counts: dict[str, Counter] = {}
    table = grams.toArrow()
    for lang, g, n in zip(*(table.column(c).to_pylist() for c in ("lang", "gram", "n"))):
        counts.setdefault(lang, Counter())[g] = n
    if not counts:
        return Model([], order)
    model = build(counts, order)
    held = drawn.where("not counts").select("lang", "text")
    scored = held.mapInArrow(_entropy_rows(spark.sparkContext.broadcast(model)), f"lang string, text string, {RESULT}")
    for r in (scored.where("lang_pred = lang").groupBy("lang")
              .agg(F.expr("percentile(cross_entropy, array(0.5, 0.99))").alias("q")).collect()):
        # the sample is too small to see the far tail, so the limit lies well beyond the 99th percentile
        limit = r["q"][0] + margin * max(r["q"][1] - r["q"][0], 0.1)
        model.limits[r["lang"]] = min(model.limits[r["lang"]], limit)
    return model


def identify(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy and rejected, after ``prefix`` (columns of these names are replaced)."""
    prepare(docs.sparkSession)
    result = ", ".join(prefix + c for c in RESULT.split(", "))
    names = {c.split()[0] for c in result.split(", ")}
    kept = docs.drop(*[c for c in docs.columns if c in names])
    if not model.languages:
        return kept.withColumns({f"{prefix}lang_pred": F.lit(UNDETERMINED), f"{prefix}score": F.lit(0.0),
                                 f"{prefix}cross_entropy": F.lit(None).cast("double"), f"{prefix}rejected": F.lit(True)})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(_entropy_rows(docs.sparkSession.sparkContext.broadcast(model), prefix), f"{fields}, {result}")
