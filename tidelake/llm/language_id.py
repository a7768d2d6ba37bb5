"""Operator 4, language identification by cross-parsing entropy.

Of every language a bounded sample of labelled rows is drawn and the suffix automaton of their whole texts built. A
text is parsed greedily into the longest phrases that occur in the sample (letters only, lower-cased, other
characters read as one space). All languages pay the same for a phrase, log2 of the largest sample, and a letter
that a sample lacks is a phrase of its own that costs log2 of all samples' letters besides. So the language that
needs the fewest phrases per symbol wins, and a sample of a few letters wins nothing by being small.

Each automaton has its own letters, however many. It becomes a double array (base of a state + symbol -> owner and
target), so that one numpy step advances many texts by a symbol. Long texts run as lanes of ``LANE`` symbols; each
lane starts a phrase.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if there is nothing to
learn from; equal entropies go to the language with the larger sample, then to the first by name; null lang is never
learnt from; repeated rows each get a row; a null doc_id is held in; very long texts are parsed whole, in lanes; an
empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import documents

#: The sample of a language: at most so many rows. This bounds what the driver gets.
SAMPLE_ROWS = 32
#: Symbols: a letter that the language's sample lacks, any run of other characters; letters follow.
OTHER, SPACE = 0, 1
LANE = 1024
#: Fixed value: what a text without a language is given.
UNDETERMINED = "und"
#: Characters of text that a task holds as symbols at once (a single longer text is held alone).
BATCH_CHARS = 2_000_000


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[str, list[str]]:
    """Whole texts of up to ``sample_rows`` rows per language, chosen by hash among those that are not held out."""
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0))
    rows = rows.select("lang", F.pmod(F.xxhash64("doc_id"), F.lit(sample_rows)).alias("slot"), F.struct(F.xxhash64("doc_id", F.lit(1)).alias("draw"), "text").alias("drawn"))
    drawn = rows.groupBy("lang", "slot").agg(F.min("drawn").alias("best")).select("lang", "slot", "best.text").collect()
    found: dict[str, list[str]] = {}
    for r in sorted(drawn, key=lambda r: (r["lang"], r["slot"])):
        found.setdefault(r["lang"], []).append(r["text"])
    return found


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def letters_of(texts: list[str]) -> list[str]:
    """The letters of a sample in lower case."""
    points = np.unique(code_points("".join(texts).lower()))
    return [chr(p) for p in points[_letters()[points]]]


def symbol_table(letters: list[str]) -> np.ndarray:
    """Symbol of each code point; capitals as their letters."""
    table = np.where(_letters(), OTHER, SPACE).astype(np.int32)
    for i, c in enumerate(letters):
        for form in (c, c.upper()):
            if len(form) == 1:
                table[ord(form)] = 2 + i
    return table


def _collapsed(points: np.ndarray) -> np.ndarray:
    """Which characters stay when what is no letter becomes one space."""
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] = True
    return keep


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
        last = new
    return moves


class Automaton:
    """All transitions in one array. State and symbol meet at base[state] + symbol, whose owner tells if the transition exists."""

    def __init__(self, symbols: list[int], size: int):
        moves = suffix_automaton(symbols)
        degree = np.fromiter(map(len, moves), np.int64, len(moves))
        edges = np.cumsum(degree) - degree
        symbol = np.fromiter((c for to in moves for c in to), np.int64, int(degree.sum()))
        target = np.fromiter((t for to in moves for t in to.values()), np.int64, len(symbol))
        room = 2 * len(symbol) + 16  # half of it stays free, so that a place is found in a few draws
        self.base = np.zeros(len(moves), np.int32)
        self.owner, self.target = np.full(room + size, -1, np.int32), np.zeros(room + size, np.int32)
        self.first = np.zeros(size, np.int32)
        for c, t in moves[0].items():
            self.first[c] = t
        draw, claimed = np.random.default_rng(0), np.zeros(room + size, np.int64)
        for n in np.unique(degree)[::-1].tolist():  # states with many transitions choose first
            left = np.flatnonzero(degree == n) if n else np.zeros(0, np.int64)
            while len(left):
                base = draw.integers(0, room, len(left))
                at = edges[left][:, None] + np.arange(n)
                slots = base[:, None] + symbol[at]
                fits = (self.owner[slots] < 0).all(1)
                claimed[slots[fits]] = np.flatnonzero(fits)[:, None]
                fits[fits] = (claimed[slots[fits]] == np.flatnonzero(fits)[:, None]).all(1)
                self.base[left[fits]] = base[fits]
                self.owner[slots[fits]] = left[fits][:, None]
                self.target[slots[fits]] = target[at[fits]]
                left = left[~fits]

    def phrases(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each lane, and how many of them are letters that the sample lacks.

        Lanes come longest first, so that those still running are the first ones. State 0 is one without an open phrase.
        """
        state, ended, lacking = (np.zeros(len(starts), np.int32) for _ in range(3))
        running = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
        for t, n in enumerate(running.tolist()):
            now, symbol = state[:n], symbols[starts[:n] + t]
            slot, first = self.base[now] + symbol, self.first[symbol]
            goes_on = self.owner[slot] == now
            ended[:n] += ~goes_on & (now > 0)
            lacking[:n] += ~goes_on & (first == 0)
            state[:n] = np.where(goes_on, self.target[slot], first)
        return ended + lacking + (state > 0), lacking


class Model:
    """What the executors get: letters and an automaton per language, bounded by the sample."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs, self.letters, self.automata, sizes = [], [], [], []
        for lang in sorted(samples):
            letters, points = letters_of(samples[lang]), code_points(" ".join(samples[lang]))
            symbols = symbol_table(letters)[points[_collapsed(points)]]
            self.langs.append(lang)
            self.letters.append(letters)
            self.automata.append(Automaton(symbols.tolist(), 2 + len(letters)))
            sizes.append(len(symbols))
        self.phrase_bits = math.log2(max(2, *sizes, 2))
        self.letter_bits = math.log2(2 + len({c for letters in self.letters for c in letters}))
        #: Languages by sample, the largest first: of equal ones the first is taken.
        self.order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], self.langs[k]))


def _entropies(texts: list[str], model: Model, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages) cross entropies, and which texts have a letter."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = code_points("".join(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    lettered = np.bincount(owner[_letters()[points]], minlength=len(texts)) > 0
    keep = _collapsed(points)
    keep[(np.cumsum(sizes) - sizes)[sizes > 0]] = True  # a run of spaces over the edge of two texts counts for both
    points, owner = points[keep], owner[keep]
    sizes = np.bincount(owner, minlength=len(texts))
    begins = np.cumsum(sizes) - sizes
    lanes = -(-sizes // LANE)
    lane_text = np.repeat(np.arange(len(texts)), lanes)
    nth = np.arange(len(lane_text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    starts = begins[lane_text] + nth * LANE
    lengths = np.minimum(sizes[lane_text] - nth * LANE, LANE)
    order = np.argsort(-lengths, kind="stable")
    out = np.empty((len(texts), len(model.langs)))
    for k, automaton in enumerate(model.automata):
        phrases, lacking = automaton.phrases(tables[k][points], starts[order], lengths[order])
        bits = phrases * model.phrase_bits + lacking * model.letter_bits
        out[:, k] = np.bincount(lane_text[order], bits, len(texts)) / np.maximum(sizes, 1)
    return out, lettered


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    tables = [symbol_table(letters) for letters in model.letters]
    for batch in batches:
        names_out = [*batch.schema.names, "lang_pred", "score", "lettered"]
        texts = [x or "" for x in batch.column(1).to_pylist()]
        cuts, room = [0], 0
        for i, x in enumerate(texts):
            if room and room + len(x) > BATCH_CHARS:
                cuts.append(i)
                room = 0
            room += len(x)
        for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True):
            entropy, lettered = _entropies(texts[a:b], model, tables)
            others = [c.slice(a, b - a) for c in batch.columns]  # pass through as they came
            if not model.langs:
                yield pa.record_batch([*others, pa.array([UNDETERMINED] * (b - a), pa.string()), pa.array(np.zeros(b - a)), pa.array(lettered)], names_out)
                continue
            entropy = entropy[:, model.order]
            best = entropy.argmin(1)
            least = np.partition(entropy, min(1, entropy.shape[1] - 1), 1)
            second = least[:, 1] if entropy.shape[1] > 1 else np.full(len(least), np.inf)
            score = np.where(np.isinf(second), 1.0, second / np.maximum(least[:, 0] + second, 1e-12))
            names = [model.langs[model.order[k]] if ok else UNDETERMINED for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            yield pa.record_batch([*others, pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(lettered)], names_out)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns, text, lang_pred, score and lettered (whether the text has a letter, which holds without a model too) of every document."""
    rows = docs.select(F.col(keep[0]), "text", *keep[1:]) if keep[0] != "text" else docs.select(F.lit(None).cast("int").alias("_"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", lang_pred string, score double, lettered boolean"
    return rows.mapInArrow(lambda it: _predict(it, model), schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = Model(training_sample(docs))
    return predict(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
ORACLES: dict[str, str] = {}
