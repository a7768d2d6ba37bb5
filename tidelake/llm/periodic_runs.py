"""Operator 13, periodic runs: stretches of words that repeat with a period, found by Karp-Miller-Rosenberg naming.

1. The words of a block of documents get numbers, and so do, level by level, all stretches of 2, 4, 8, ... words:
   a stretch is named by the pair of names of its halves, so equal names mean equal words. A stretch that the block
   holds once gets no name; naming ends at the level where nothing repeats, after a few levels in usual text.
2. How far two places agree (LCE) is read off from the highest level down to the words, forwards and backwards.
3. A run of period q and at least 3q words holds two neighbours of the grid 0, q, 2q, ... that agree for more than
   q words. Grid neighbours whose names of one level agree are the candidates, n/q of each period; each is
   extended by LCE in both directions. Of the periods found for one stretch the smallest is its own.

Everything of a document happens in one task, many documents at a time, in arrays that are proportional to its
words; nothing is shuffled.

Defined results: a null or empty text has no words and no runs; a word is never part of two documents' run;
repeated rows each get a row; a null doc_id stays null; very long texts are read whole, as a block of their own;
an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import documents, text_of

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: A block of documents: so many bytes of text, or one longer document.
BLOCK_BYTES = 3_000_000
#: Grid candidates looked at in one step.
STEP = 1_000_000
#: A stretch without a name, as it is met once only.
ALONE = -1

SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"

#: (doc_id, number of words) -> which words to read in their place, or None for the words as they are.
Rewrite = Callable[[int | None, int], np.ndarray | None]


def _named(keys: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Names of the keys at places ``at``; a key met once has none."""
    names = np.full(size + 1, ALONE, np.int32)  # one more, so that a place past the end has no name
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    names[at] = np.where(counts[which] > 1, which, ALONE)
    return names


class Names:
    """Names of all stretches of 2^k words, one array per level; ``words`` are numbers, ALONE between documents."""

    def __init__(self, words: np.ndarray):
        self.size = len(words)
        at = np.flatnonzero(words != ALONE)
        self.levels = [_named(words[at], at, self.size)]
        while True:
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            at = np.flatnonzero(last[: max(0, self.size - half)] != ALONE)
            at = at[last[at + half] != ALONE]
            names = _named(last[at].astype(np.int64) << 32 | last[at + half], at, self.size)
            if not (names != ALONE).any():
                break
            self.levels.append(names)

    def agree(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        names = self.levels[level]
        a = names[np.minimum(i, self.size)]
        return (a == names[np.minimum(j, self.size)]) & (a != ALONE)

    def forwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and j on agree. Nothing repeats above the highest level, so each level counts once."""
        far = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            far += self.agree(level, i + far, j + far).astype(np.int64) << level
        return far

    def backwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and j agree, where i is the smaller."""
        far = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            a, b = i - far - (1 << level), j - far - (1 << level)
            far += ((a >= 0) & self.agree(level, np.maximum(a, 0), np.maximum(b, 0))).astype(np.int64) << level
        return far


def _periods(names: Names, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, periods) to look at together: their runs agree for 2^level words at some grid place, and names say so."""
    level_of = lambda q: (max(LEAST_WORDS, LEAST_PERIODS * q) - 2 * q + 1).bit_length() - 1
    held: list[int] = []
    room = 0
    for q in range(1, longest // LEAST_PERIODS + 1):
        level = level_of(q)
        if level >= len(names.levels):
            if q >= LEAST_WORDS:  # from here on, levels only rise
                break
            continue
        if held and (level != level_of(held[0]) or room >= STEP):
            yield level_of(held[0]), np.array(held)
            held, room = [], 0
        held.append(q)
        room += names.size // q + 1
    if held:
        yield level_of(held[0]), np.array(held)


def find_runs(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all runs in ``words`` (ALONE between documents), by start, then period.

    ``longest`` bounds the number of words of a document.
    """
    names = Names(words)
    found = np.zeros((3, 0), np.int64)  # start, end, period
    for level, periods in _periods(names, longest):
        points = np.maximum(0, (names.size - 1) // periods)  # grid neighbours i, i + q inside
        q = np.repeat(periods, points)
        i = (np.arange(len(q)) - np.repeat(np.cumsum(points) - points, points)) * q
        near = names.agree(level, i, i + q)
        i, q = i[near], q[near]
        start, end = i - names.backwards(i, i + q), i + q + names.forwards(i, i + q)
        whole = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        found = np.concatenate([found, [start[whole], end[whole], q[whole]]], 1)
        found = found[:, np.lexsort(found[::-1])]  # by start, end, period: the first of a stretch has its smallest period
        new = np.append(True, (found[0, 1:] != found[0, :-1]) | (found[1, 1:] != found[1, :-1])) if found.shape[1] else np.zeros(0, bool)
        found = found[:, new]
    found = found[:, np.lexsort((found[2], found[0]))]
    return found[0], found[1] - found[0], found[2]


def _block(ids: list[int | None], texts: list[bytes], rewrite: Rewrite | None) -> pa.RecordBatch:
    split = [x.split() for x in texts]  # of bytes: at [\x20\x09-\x0D]+ exactly
    coded = pa.array([w for ws in split for w in ws], pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    counts = np.fromiter(map(len, split), np.int64, len(split))
    begins = np.cumsum(counts + 1) - counts - 1  # a word without a number after each document
    numbers = np.full(int(counts.sum()) + len(split), ALONE, np.int64)
    numbers[np.arange(len(coded)) + np.repeat(np.arange(len(split)), counts)] = coded
    for k, (doc_id, n) in enumerate(zip(ids, counts.tolist(), strict=True)):
        if rewrite and (read := rewrite(doc_id, n)) is not None:
            split[k] = [split[k][w] for w in read.tolist()]
            numbers[begins[k] : begins[k] + n] = numbers[begins[k] + read]
    start, length, period = find_runs(numbers, int(counts.max(initial=0)))
    dropped = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, start + length, -1)
    stays = np.cumsum(dropped)[:-1] == 0
    edges = np.searchsorted(start, np.append(begins, len(numbers)))
    touched = np.diff(edges) > 0
    runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(start - np.repeat(begins, np.diff(edges))), pa.array(length), pa.array(period)], ["start", "length", "period"]))
    kept = [b" ".join([w for w, stay in zip(ws, stays[a : a + len(ws)].tolist(), strict=True) if stay] if hit else ws) for ws, a, hit in zip(split, begins.tolist(), touched.tolist(), strict=True)]
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(counts), runs, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def _found(batches: Iterator[pa.RecordBatch], rewrite: Rewrite | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, a = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + BLOCK_BYTES, "right")))
            part = batch.slice(a, b - a)
            yield _block(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist(), rewrite)
            a = b


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed text of every document.

    The collapsed text keeps the first period of each run, words joined by one space.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(lambda it: _found(it, rewrite), SCHEMA)


def planted_period(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's own runs: every tenth document by the crc of its id repeats from word a on with period p."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period; of equal ones the first by start, then period."""
    return F.reduce(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(documents(spark, sf_dir), planted_period).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES: dict[str, str] = {}
