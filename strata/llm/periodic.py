"""Periodic runs of words, and texts collapsed to one period of each run.

Online dyadic square catching. For every power of two B, each aligned block of B words becomes a *catcher* when it is
complete. A square whose period q lies between 2B-1 and 4B-2 holds such a block in its first half, and the block recurs q
words later. Every appended word completes one window of B words per level; the window's hash is compared with the
catchers in whose reach it begins (always two). Window hashes of a level are made of two hashes of the level below, so a
level keeps one hash per block and those of its last B windows, and an appended word costs a constant per level.

A caught block is a piece of a square. Catches of one period by consecutive blocks are chained; a chain too short for the
wanted exponent is dropped. The others are compared word by word, extended to both sides, and so merge into maximal
runs. Stretches whose smallest period is a proper divisor of theirs are known from a lower level and left out.

Words are numbered by their bytes, so hashes only propose. Documents of a block are appended to one catcher, each followed by a
separator that equals no other word, so no run crosses documents.

Defined results: words are the runs of characters other than ASCII white space; null, empty and blank texts have no words, no
run and an empty collapsed text; the strongest run is null then. Every row gives a row, repeated rows too; other columns
stay, and those with the name of a result are replaced. An empty table gives an empty result. A text is worked on
whole, in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix64, prepare, text_blocks

#: Words appended at a time.
CHUNK = 1 << 16
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Growing:
    """An array that is appended to."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1024, dtype=kind), 0

    def add(self, new: np.ndarray) -> None:
        if self.n + len(new) > len(self.data):
            self.data = np.concatenate([self.data[:self.n], np.zeros(max(self.n, len(new)) + 1024, dtype=self.data.dtype)])
        self.data[self.n:self.n + len(new)] = new
        self.n += len(new)

    def all(self) -> np.ndarray:
        return self.data[:self.n]


class Level:
    """The catchers of one block size."""

    def __init__(self, size: int):
        self.size, self.done = size, 0
        self.blocks = Growing(np.uint64)          # hash of each completed block
        self.last = np.zeros(0, dtype=np.uint64)  # hashes of the last windows, at most ``size``
        self.caught: list[np.ndarray] = []        # rows (period, first block, last block)

    def add(self, new: np.ndarray) -> np.ndarray:
        """Compare the new windows with the catchers. Gives the new windows of twice the size."""
        size = self.size
        starts = np.arange(self.done, self.done + len(new))
        self.blocks.add(new[-self.done % size::size])
        nearest = (starts - (2 * size - 1)) // size
        blocks, found = self.blocks.all(), []
        for block in (nearest, nearest - 1):
            known = int(np.searchsorted(block, 0))  # block numbers ascend
            hit = known + np.flatnonzero(blocks[block[known:]] == new[known:])
            if len(hit):
                found.append(np.stack([starts[hit] - block[hit] * size, block[hit], block[hit]]))
        if found:
            self.caught.append(chained(np.concatenate(found, axis=1)))
        self.done += len(new)
        windows = np.concatenate([self.last, new])
        self.last = windows[-size:]
        return mix64(windows[:-size] * _LEFT + windows[size:] * _RIGHT) if len(windows) > size else windows[:0]


def chained(caught: np.ndarray) -> np.ndarray:
    """Catches (period, first block, last block) of one period whose blocks follow each other become one."""
    period, first, last = caught[:, np.lexsort((caught[1], caught[0]))]
    begins = np.flatnonzero(np.concatenate([[True], (period[1:] != period[:-1]) | (first[1:] != last[:-1] + 1)]))
    ends = np.append(begins[1:], len(period)) - 1
    return np.stack([period[begins], first[begins], last[ends]])


class Catcher:
    """Runs of a growing sequence of word numbers.

    exponent: a run has at least that many periods (2 or more); longest: length of the longest sequence without a separator, which
    bounds the periods."""

    def __init__(self, exponent: int, longest: int):
        if exponent < 2:
            raise ValueError("a run has at least two periods")
        self.exponent, self.longest = exponent, longest
        self.words, self.levels = Growing(np.int64), []

    def append(self, words: np.ndarray) -> None:
        for at in range(0, len(words), CHUNK):
            part = words[at:at + CHUNK]
            self.words.add(part)
            new, size, level = mix64(part.astype(np.int64).view(np.uint64)), 1, 0
            while len(new) and (2 * size - 1) * self.exponent <= self.longest:
                if level == len(self.levels):
                    self.levels.append(Level(size))
                new, size, level = self.levels[level].add(new), 2 * size, level + 1

    def runs(self, min_length: int = 0) -> np.ndarray:
        """Rows (start, length, period) of the runs so far, in order of start, then period."""
        words, n = self.words.all(), self.words.n
        known = [Growing(np.int64) for _ in range(3)]  # starts, ends, periods
        for level in self.levels:
            if not level.caught:
                continue
            size, stretch = level.size, self.exponent - 1
            period, first, last = chained(np.concatenate(level.caught, axis=1))
            # aligned blocks that any run of the level holds whole, a period before its end
            blocks = max(1, (stretch * (2 * size - 1) - (size - 1)) // size)
            keep = last - first + 1 >= blocks
            for q, lo, hi in zip(*(x[keep].tolist() for x in (period, first * size, (last + 1) * size))):
                starts, ends, periods = (x.all() for x in known)
                if len(starts) and ((starts <= lo) & (ends >= hi + q) & (q % periods == 0)).any():
                    continue
                a, b = max(0, lo - size), min(n - q, hi + size)
                same = np.concatenate([[0], (words[a:b] == words[a + q:b + q]).astype(np.int8), [0]])
                edge = np.diff(same)
                for s, e in zip((np.flatnonzero(edge == 1) + a).tolist(), (np.flatnonzero(edge == -1) + a + q).tolist()):
                    if e - s < max(min_length, self.exponent * q):
                        continue
                    starts, ends, periods = (x.all() for x in known)
                    if not ((starts <= s) & (ends >= e) & (q % periods == 0)).any():
                        for x, v in zip(known, (s, e, q)):
                            x.add(np.array([v]))
        starts, ends, periods = (x.all() for x in known)
        return np.stack([starts, ends - starts, periods], axis=1)[np.lexsort((periods, starts))]


def runs_by_text(texts: list[np.ndarray], exponent: int, min_length: int) -> list[np.ndarray]:
    """The runs (start, length, period) of each sequence of word numbers (0 or more)."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    catcher = Catcher(exponent, int(lengths.max(initial=0)))
    for i, t in enumerate(texts):
        texts[i] = np.append(t, -1 - i)
    catcher.append(np.concatenate(texts) if texts else np.zeros(0, np.int64))
    found = catcher.runs(min_length)
    begins = np.cumsum(lengths + 1) - lengths - 1
    owner = np.searchsorted(begins, found[:, 0], side="right") - 1
    found[:, 0] -= begins[owner]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [found[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; of equal ones the first, then that of the smallest period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that stand in no run behind its first period."""
    if not len(runs):
        return b" ".join(words)
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs.tolist():
        kept[start + period:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


RESULTS = {"n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint",
           "runs": "array<struct<start: bigint, length: bigint, period: bigint>>", "collapsed": "string"}
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _find(names: list[str], exponent: int, min_length: int, rewrite):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            number: dict[bytes, int] = {}
            split, numbered = [], []
            keys = batch.column("doc_id").to_pylist() if rewrite else [None] * len(texts)
            for key, t in zip(keys, texts):
                words = t.encode("utf-8", "replace").split()  # bytes.split takes ASCII white space only
                if rewrite and words and (order := rewrite(key, len(words))) is not None:
                    words = [words[i] for i in order]
                split.append(words)
                numbered.append(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64))
            runs = runs_by_text(numbered, exponent, min_length)
            best = [strongest(r) or (None,) * 3 for r in runs]
            flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            items = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], ["start", "length", "period"])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32))
            made = {"n_runs": pa.array([len(r) for r in runs], pa.int64()),
                    **{c: pa.array([b[k] for b in best], pa.int64()) for k, c in enumerate(("start", "length", "period"))},
                    "runs": pa.ListArray.from_arrays(offsets, items).cast(_RUNS),
                    "collapsed": pa.array([collapsed(w, r).decode("utf-8") for w, r in zip(split, runs)], pa.string())}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made.values()], names=[*names, *made])
    return find


def find_runs(docs: DataFrame, exponent: int = 4, min_length: int = 6,
              rewrite: Callable[[int | None, int], list[int] | None] | None = None) -> DataFrame:
    """``docs`` with n_runs, the strongest run (start, length, period), all runs and the collapsed text.

    A run is a maximal stretch of words of smallest period q with at least max(min_length, exponent * q) words.
    rewrite: of a row's doc_id and its number of words, the numbers of the words to look at instead (None: as they are)."""
    prepare(docs.sparkSession)
    names = [c for c in docs.columns if c not in RESULTS]
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields if f.name in names)
    return docs.select(*names).mapInArrow(_find(names, exponent, min_length, rewrite),
                                          kept + ", ".join(f"{c} {kind}" for c, kind in RESULTS.items()))
