"""Operator 5, best-fit packing of token sequences by exact-complement hashing.

1. Every text is tokenised (a task keeps each distinct word's ids), closed with the end id, and cut
   into pieces of at most ``capacity`` tokens. The pieces are written to the shared folder.
2. Only the histogram of piece lengths, at most ``capacity`` numbers, goes to the driver. There the
   combinations are planned: for the longest length left, the gap's exact complement is looked up as a
   single length, a pair sum, then a triple sum, and consumed as often as counts allow. Lengths without
   a complement are placed best-fit.
3. The plan is a list of slots: of length L, ranks r to r+t lie at one offset of consecutive sequences.
   Pieces are ranked within their length by prefix sums over tasks, and joined to the slots by
   (length, block of ranks). No step holds all pieces of a length.

Defined results: a null or empty text is one piece holding the end id; repeated rows are packed each;
a null doc_id stays null; ties are broken by task and order of reading, so sequence numbers may differ
between runs while their number doesn't; very long texts are tokenised whole and only then cut; further columns are ignored; an empty table packs into nothing.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.llm.bpe_codec import byte_of_character, special_texts, tokenizer
from tidelake.llm.common import documents, materialised, text_of

# The public pre-token expression of the lower-casing tokenizer for PLAIN texts; letters come first, which is quicker and splits alike.
SPLIT = r"\p{L}+|\p{N}|'(?:s|t|re|ve|m|ll|d)|[^\s\x85\xA0\p{L}\p{N}]+"
#: Texts of these characters alone are split by Spark: they are in normal form, and both sides lower-case them alike.
PLAIN = r"^[\x09-\x0D\x20-\x7E\xA0-\xFF]*$"
#: Slots are joined to pieces by blocks of so many ranks.
RANK_BLOCK = 4096

PIECES_SCHEMA = "doc_id bigint, piece int, start bigint, length int, ids binary, part string, nth bigint"


def _tokenised(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    tok, known, seen, part = tokenizer(path), {}, Counter(), uuid.uuid4().hex
    # the model's own alphabet writes each byte as a character
    alphabet, model = {b: c for c, b in byte_of_character().items()}, tok.model
    encode = lambda w: np.array([t.id for t in model.tokenize(w.encode().decode("latin-1").translate(alphabet))], "<u4").tobytes()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids", "part", "nth"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64()]
    for batch in batches:
        coded = batch.column(1).flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        for w in distinct:
            if w not in known:
                known[w] = encode(w)
        table, at = [known[w] for w in distinct], coded.indices.to_numpy(zero_copy_only=False)
        counts, start, rows = batch.column(1).value_lengths().to_pylist(), 0, []
        for doc_id, count, whole in zip(batch.column(0).to_pylist(), counts, batch.column(2).to_pylist(), strict=True):
            own = at[start : start + count].tolist()
            start += count
            ids = b"".join([table[i] for i in own]) if whole is None else np.array(tok.encode(whole, add_special_tokens=False).ids, "<u4").tobytes()
            ids += end
            for k in range(0, len(ids), 4 * capacity):
                cut = ids[k : k + 4 * capacity]
                length = len(cut) // 4
                rows.append((doc_id, k // (4 * capacity), k // 4, length, cut, part, seen[length]))
                seen[length] += 1
            if len(rows) >= 500:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Token pieces: doc_id, piece, start, length, ids; part and nth number the pieces of a length within a task."""
    text = text_of()
    plain = F.regexp_like(text, F.lit(PLAIN))
    for special in special_texts(path):
        plain = plain & ~F.contains(text, F.lit(special))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), plain.alias("plain"))
    words = F.when(F.col("plain"), F.regexp_extract_all(F.lower("text"), F.lit(SPLIT), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", words.alias("words"), F.when(~F.col("plain"), F.col("text")).alias("whole"))
    return rows.mapInArrow(lambda it: _tokenised(it, path, capacity, end_id), PIECES_SCHEMA)


class Complements:
    """Counts of lengths, with the sums of one, two and three of them as an index of what fills a gap exactly."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.count[length] = n
        self._pairs: np.ndarray | None = None

    def pair_sums(self) -> np.ndarray:
        """Which sums of two present lengths there are; kept until a lookup turns out to be stale."""
        if self._pairs is None:
            there = (self.count > 0).astype(np.float64)
            size = 2 * (self.capacity + 1)
            wave = np.fft.rfft(there, size)
            self._pairs = np.rint(np.fft.irfft(wave * wave, size))[: self.capacity + 1] > 0
        return self._pairs

    def _pair(self, total: int) -> tuple[int, int] | None:
        """The pair with the longest member: it leaves the short lengths, which fit anywhere."""
        if total < 2:
            return None
        longer = np.arange(total - 1, (total - 1) // 2, -1)
        fits = np.flatnonzero((self.count[longer] > 0) & (self.count[total - longer] > 0))
        for i in fits[:2]:
            a = int(longer[i])
            if a != total - a or self.count[a] > 1:
                return a, total - a
        return None

    def filling(self, gap: int) -> tuple[int, ...] | None:
        """Present lengths that sum to ``gap``: one, two or three of them."""
        if self.count[gap] > 0:
            return (gap,)
        if pair := self._pair(gap):
            return pair
        for fresh in (False, True):
            first = np.arange(gap - 2, 0, -1)
            first = first[(self.count[first] > 0) & self.pair_sums()[gap - first]]
            for a in first.tolist():
                self.count[a] -= 1
                pair = self._pair(gap - a)
                self.count[a] += 1
                if pair:
                    return (a, *pair)
            if not len(first) or fresh:
                return None
            self._pairs = None
        return None


def plan_combinations(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths and how often each is used; every piece is in one. Works on the histogram alone."""
    left = Complements(counts, capacity)
    plan: list[tuple[tuple[int, ...], int]] = []
    if left.count[capacity]:
        plan.append(((capacity,), int(left.count[capacity])))
        left.count[capacity] = 0
    residual: dict[int, int] = {}
    for length in range(capacity - 1, 0, -1):
        while left.count[length] > 0:
            left.count[length] -= 1
            fill = left.filling(capacity - length)
            left.count[length] += 1
            if fill is None:
                residual[length] = int(left.count[length])
                left.count[length] = 0
                break
            used = Counter((length, *fill))
            times = min(int(left.count[x]) // n for x, n in used.items())
            for x, n in used.items():
                left.count[x] -= n * times
            plan.append(((length, *fill), times))
    return plan + _best_fit(residual, capacity)


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on groups of equal sequences: a piece goes where the least room is left over."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room left
    rooms = np.zeros(capacity + 1, bool)
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                per = capacity // length  # new sequences hold as many of this length as go in
                if full := n // per:
                    open_[capacity - per * length].append(((length,) * per, full))
                    rooms[capacity - per * length] = True
                if n % per:
                    open_[capacity - n % per * length].append(((length,) * (n % per), 1))
                    rooms[capacity - n % per * length] = True
                break
            room = int(fits[0]) + length
            combo, times = open_[room].pop()
            rooms[room] = bool(open_[room])
            if times > n:
                open_[room].append((combo, times - n))
                rooms[room] = True
            placed = min(times, n)
            open_[room - length].append((combo + (length,), placed))
            rooms[room - length] = True
            n -= placed
    return [x for group in open_.values() for x in group]


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset) of every place in the plan."""
    used: Counter = Counter()
    out, sequence = [], 0
    for combo, times in plan:
        offset = 0
        for length in combo:
            out.append((length, used[length], times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return out


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialised(cut_pieces(docs, path, capacity, end_id))
    per_task = materialised(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    rows = slots(plan_combinations(counts, capacity))
    plan = spark.createDataFrame(rows, "length int, first bigint, times bigint, sequence bigint, offset bigint")
    blocks = F.sequence(F.floor(F.col("first") / RANK_BLOCK), F.floor((F.col("first") + F.col("times") - 1) / RANK_BLOCK))
    plan = plan.withColumn("rank_block", F.explode(blocks))
    ranked = pieces.drop("ids").join(bases.hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    ranked = ranked.withColumn("rank_block", F.floor(F.col("rank") / RANK_BLOCK))
    within = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("times"))
    placed = ranked.join(plan.hint("merge"), ["length", "rank_block"]).filter(within)
    placed = placed.select("part", "length", "nth", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
    return pieces.join(placed.hint("merge"), ["part", "length", "nth"]).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids", "sequence_id", "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLES: dict[str, str] = {}
