"""Operator 1, suffix-array dedup of repeated byte strings.

Every text is a string of bytes; a window is ``WINDOW`` consecutive bytes of one document. Windows
travel to shards as super-k-mers (see ``superkmer``). In a shard
- strings whose minimiser occurs once have no partner and drop out, of equal strings the earliest stays;
- the suffix array of what is left is built by Larsson-Sadakane refinement in numpy: suffixes are sorted
  by 8 bytes, then groups that still tie are refined by the ranks found so far, doubling the depth
  until none ties (strings are distinct and of two windows at most, so a few rounds do);
- Kasai's common prefixes, computed for many positions at once, tell where windows agree;
- strings of one minimiser that outgrow a shard are cut into several shards, whose suffix arrays are
  merged by binary search of one's windows in the other's.
Of equal windows the earliest (smaller doc_id, then earlier start) stays, all others are covered.

Defined results: a null text is empty; texts shorter than a window stay whole; equal rows of one doc_id
are one occurrence, not two; a null doc_id counts as larger than all others; what is left of a text
need not be valid UTF-8, so it is binary; repeated rows each get a row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import documents
from tidelake.llm.superkmer import Block, minimiser_runs, mixed, opened, packed, plain, repeated_spans, runs, shipped_rows, with_spans

WINDOW, MINIMISER = 100, 16
#: Text of one suffix array.
SHARD_BYTES = 3_000_000
#: Minimisers by which a family of strings is cut, one after the other, before its shards are searched pair by pair.
MOST_MINIMISERS = 4
#: Strings that are cut at once.
PARTED_BYTES = 4_000_000
#: Bytes that no UTF-8 text has end every string of a shard.
END = 0xFF


def _eights(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a number that orders as they do."""
    k, width = text.astype(np.uint64), 1
    while width < 8:
        ahead = np.zeros_like(k)
        ahead[:-width] = k[width:]
        k = (k << np.uint64(8 * width)) | ahead
        width *= 2
    return k


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes at least: Larsson-Sadakane, refining only groups that tie."""
    n = len(text)
    key = _eights(text)
    sa = np.argsort(key)
    rank = np.empty(n, np.int64)

    def regroup(places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """New ranks for sorted suffixes at ``places``; returns the places that still tie."""
        new = np.ones(len(places), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (places[1:] != places[:-1] + 1)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(places)))
        rank[sa[places]] = np.repeat(places[start], size)
        return places[np.repeat(size > 1, size)]

    places = regroup(np.arange(n), key[sa])
    reach = 8
    while reach < depth and len(places):
        suffixes = sa[places]
        ahead = np.minimum(suffixes + reach, n)
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[suffixes] * np.int64(n + 1) + second
        order = np.argsort(key)
        sa[places] = suffixes[order]
        places = regroup(places, key[order])
        reach *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, limit: int, lanes: int = 1 << 14) -> np.ndarray:
    """Kasai's array: of each place in ``sa``, the bytes shared with the place before, ``limit`` at most.

    The prefix of position i + 1 is at most one shorter than that of i, if ``sa`` is sorted to the end.
    Lanes start at positions far apart and walk at once, eight bytes a step.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    eights = np.append(_eights(text), np.zeros(limit + 8, np.uint64))
    shared = np.zeros(n, np.int64)
    stride = max(1, -(-n // lanes))
    for step in range(stride):
        at = np.arange(step, n, stride)
        length = np.maximum(shared[at - 1] - 1, 0) if step else np.zeros(len(at), np.int64)
        other = before[at]
        open_ = np.flatnonzero(other >= 0)
        length[other < 0] = 0
        while len(open_):
            a, b, own = at[open_], other[open_], length[open_]
            differ = eights[a + own] ^ eights[b + own]
            equal = np.where(differ == 0, 8, 0)
            for k in range(1, 8):
                equal += ((differ != 0) & (differ < (np.uint64(1) << np.uint64(64 - 8 * k)))).astype(np.int64)
            room = n - np.maximum(a, b)
            length[open_] = np.minimum(np.minimum(own + equal, room), limit)
            open_ = open_[(equal == 8) & (length[open_] < np.minimum(limit, room))]
        shared[at] = length
    return shared[sa]


class Shard:
    """A suffix array over some strings, and of each window among them the earliest occurrence known."""

    def __init__(self, strings: list[bytes], ids: np.ndarray, starts: np.ndarray):
        sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
        self.text = np.frombuffer(b"".join([s + bytes([END]) for s in strings]), np.uint8)
        owner = np.repeat(np.arange(len(strings)), sizes)
        base = np.cumsum(sizes) - sizes
        sa = suffix_array(self.text, len(self.text))  # sorted to the end: Kasai's bound holds for nothing less
        shared = common_prefixes(self.text, sa, WINDOW)
        whole = sa + WINDOW < (base + sizes)[owner[sa]]
        # windows that agree stand together: a window shares WINDOW bytes with all between it and its equals
        group = np.cumsum(shared < WINDOW)[whole]
        self.window = sa[whole]
        self.string, self.offset = owner[self.window], self.window - base[owner[self.window]]
        self.ids, self.starts = ids[self.string], starts[self.string] + self.offset
        self.group = np.cumsum(np.append(0, np.diff(group) > 0)) if len(group) else group
        self.first = np.flatnonzero(np.append(True, np.diff(self.group) > 0)) if len(group) else group
        order = np.lexsort((self.starts, self.ids, self.group))
        self.least_id, self.least_start = self.ids[order][self.first], self.starts[order][self.first]
        self.eights = np.append(_eights(self.text), np.zeros(WINDOW, np.uint64))

    def _words(self, positions: np.ndarray) -> np.ndarray:
        """The WINDOW bytes at positions, as numbers that order as they do: 12 eights, and the last one overlapping."""
        at = [*range(0, WINDOW - 7, 8), WINDOW - 8]
        return np.stack([self.eights[positions + k] for k in at], 1)

    def merge(self, other: Shard) -> None:
        """Binary search of the other's distinct windows among one's own; equal ones share the earliest occurrence."""
        if not len(self.first) or not len(other.first):
            return
        sought = other._words(other.window[other.first])
        low, high = np.zeros(len(sought), np.int64), np.full(len(sought), len(self.first))
        own = self.window[self.first]
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            words = self._words(own[middle])
            differ = words != sought[open_]
            k = differ.argmax(1)
            row = np.arange(len(k))
            less = differ.any(1) & (words[row, k] < sought[open_][row, k])
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
        theirs = np.flatnonzero(low < len(self.first))
        mine = low[theirs]
        same = (self._words(own[mine]) == sought[theirs]).all(1)
        mine, theirs = mine[same], theirs[same]
        a, b = (self.least_id[mine], self.least_start[mine]), (other.least_id[theirs], other.least_start[theirs])
        earlier = (a[0] < b[0]) | ((a[0] == b[0]) & (a[1] <= b[1]))
        for shard, at in ((self, mine), (other, theirs)):
            shard.least_id[at] = np.where(earlier, a[0], b[0])
            shard.least_start[at] = np.where(earlier, a[1], b[1])

    def covered(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows that start earlier elsewhere: (string, offset), sorted."""
        least_id, least_start = self.least_id[self.group], self.least_start[self.group]
        late = (least_id < self.ids) | ((least_id == self.ids) & (least_start < self.starts))
        string, offset = self.string[late], self.offset[late]
        order = np.lexsort((offset, string))
        return string[order], offset[order]


def _hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the MINIMISER bytes from each place on, by doubling."""
    h, width = mixed(b.astype(np.uint64) + np.uint64(1)), 1
    while width < MINIMISER:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return mixed(h)


def _spread(blocks: Iterator[Block], buckets: int) -> Iterator[pa.RecordBatch]:
    for block in blocks:
        b = block.bytes
        if len(b) < WINDOW:
            continue
        h = _hashes(b)
        sizes = np.diff(block.edges)
        inside = np.zeros(len(b) + 1, np.int8)  # windows that end within their document
        long = sizes >= WINDOW
        np.add.at(inside, block.edges[:-1][long], 1)
        np.add.at(inside, block.edges[1:][long] - WINDOW + 1, -1)
        first, windows, place = minimiser_runs(h, WINDOW - MINIMISER + 1, np.cumsum(inside[: len(b) - WINDOW + 1]) > 0)
        if not len(first):
            continue
        doc = np.searchsorted(block.edges, first, "right") - 1
        ids, start = block.ids[doc], first - block.edges[doc]
        order = np.lexsort((start, ids))
        first, windows, place, doc, ids, start = (x[order] for x in (first, windows, place, doc, ids, start))
        data, stop = b.tobytes(), first + windows + WINDOW - 1
        strings = [data[x:y] for x, y in zip(first.tolist(), stop.tolist(), strict=True)]
        code = pa.array(strings, pa.binary()).dictionary_encode().indices.to_numpy()
        earliest = np.unique(code, return_index=True)[1]  # as they are sorted, the first of each string
        known = earliest[code]
        later = (ids != ids[known]) | (start != start[known])
        settled = {"doc_id": ids[later], "text_key": block.keys[doc[later]], "start": start[later], "stop": start[later] + windows[later] + WINDOW - 1}
        go = np.sort(earliest)
        bucket = (h[place[go]] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        go, bucket = go[order], bucket[order]
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(go)]
        parcels = []
        for x, y in zip(cuts, cuts[1:], strict=False):
            own = go[x:y]
            parcel = packed([strings[i] for i in own.tolist()], 4, doc_id=ids[own], text_key=block.keys[doc[own]], start=start[own], place=place[own] - first[own])
            parcels.append((int(bucket[x]), parcel))
        yield shipped_rows(parcels, settled, int(block.keys[0]) % buckets)


def _settle(payloads: list[bytes], shard_bytes: int = SHARD_BYTES) -> dict[str, np.ndarray]:
    column, numbers = opened(payloads, "doc_id", "text_key", "start", "place")
    found = list(_repeats(column, *numbers.values(), shard_bytes, ()))
    return dict(zip(("doc_id", "text_key", "start", "stop"), map(np.concatenate, zip(*found, strict=True)), strict=True))


Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _parted(strings: list[bytes], excluded: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings cut by their windows' least m-mer besides ``excluded``: (string, offset, length, place of the m-mer).

    The cut depends on a window's content alone, so equal windows get equal m-mers and still meet.
    """
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    b = np.frombuffer(b"".join(strings), np.uint8)
    h = _hashes(b)
    first_eight = _eights(b)[: len(h)]
    for mark in excluded:  # told apart by hash first
        own = np.frombuffer(mark, np.uint8)
        alike = np.flatnonzero(first_eight == _eights(own)[0])
        alike = alike[(b[alike[:, None] + np.arange(MINIMISER)] == own).all(1)]
        h[alike] = np.iinfo(np.uint64).max
    begins = np.cumsum(sizes) - sizes
    inside = np.zeros(len(b) + 1, np.int8)
    np.add.at(inside, begins, 1)
    np.add.at(inside, begins + sizes - WINDOW + 1, -1)  # each string holds a window
    first, windows, place = minimiser_runs(h, WINDOW - MINIMISER + 1, np.cumsum(inside[: len(b) - WINDOW + 1]) > 0)
    string = np.searchsorted(begins, first, "right") - 1
    return string, first - begins[string], windows + WINDOW - 1, place - first


def _repeats(column: pa.Array, ids: np.ndarray, keys: np.ndarray, start: np.ndarray, place: np.ndarray, shard_bytes: int, excluded: tuple[bytes, ...]) -> Iterator[Spans]:
    """Spans of repeated windows among strings that come by minimiser. What shares a minimiser and passes
    ``shard_bytes`` is cut anew by the next m-mer (``excluded``: those used before), up to MOST_MINIMISERS of them."""
    coded = column.dictionary_encode()
    code, distinct = coded.indices.to_numpy(), coded.dictionary
    sizes = pc.binary_length(distinct).to_numpy().astype(np.int64)
    order = np.lexsort((start, ids, code))
    earliest = order[np.unique(code[order], return_index=True)[1]]
    known = earliest[code]
    later = (ids > ids[known]) | ((ids == ids[known]) & (start > start[known]))
    found: list[Spans] = [(ids[later], keys[later], start[later], start[later] + sizes[code[later]])]
    # strings whose minimiser another string shares, minimiser by minimiser
    strings = distinct.to_pylist()
    marks = pa.array([s[p : p + MINIMISER] for s, p in zip(strings, place[earliest].tolist(), strict=True)], pa.binary()).dictionary_encode().indices.to_numpy()
    shared = np.bincount(marks)[marks] > 1
    if len(excluded) < MOST_MINIMISERS:
        hot = np.bincount(marks, sizes + 1) > shard_bytes
        for mark in np.flatnonzero(hot & (np.bincount(marks) > 1)).tolist():
            own = np.flatnonzero(marks == mark)
            used = (*excluded, strings[own[0]][place[earliest[own[0]]] :][:MINIMISER])
            parts, items, offsets, inner = [], [], [], []
            for some in np.split(own, np.flatnonzero(np.diff(np.cumsum(sizes[own]) // PARTED_BYTES)) + 1):
                string, offset, length, at = _parted([strings[i] for i in some.tolist()], used)
                parts += [strings[some[k]][o : o + n] for k, o, n in zip(string.tolist(), offset.tolist(), length.tolist(), strict=True)]
                items.append(earliest[some[string]])
                offsets.append(offset)
                inner.append(at)
            item, offset = np.concatenate(items), np.concatenate(offsets)
            yield from _repeats(pa.array(parts, pa.large_binary()), ids[item], keys[item], start[item] + offset, np.concatenate(inner), shard_bytes, used)
        shared &= ~hot[marks]
    at = np.flatnonzero(shared)
    at = at[np.argsort(marks[at], kind="stable")]
    cut, linked = [], []  # shards: (from, to), and whether a minimiser runs over from the one before
    total = np.cumsum(sizes[at] + 1)
    edges = np.flatnonzero(np.append(True, np.diff(marks[at]) != 0)) if len(at) else at
    lo = 0
    while lo < len(at):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + shard_bytes, "right"))
        hi = max(hi, lo + 1)
        if hi < len(at):
            whole = edges[np.searchsorted(edges, hi, "right") - 1]
            hi = int(whole) if whole > lo else hi
        cut.append((lo, hi))
        linked.append(bool(lo) and marks[at[lo]] == marks[at[lo - 1]])
        lo = hi
    family: list[tuple[Shard, np.ndarray]] = []

    def flush() -> None:
        for i, (a, _) in enumerate(family):  # the first shard of a window gathers, the last one learns, the others learn from it
            for b, _ in family[i + 1 :]:
                a.merge(b)
        for shard, own in family:
            string, offset = shard.covered()
            if len(string):
                new = np.append(True, (np.diff(string) != 0) | (np.diff(offset) != 1))
                run = np.flatnonzero(new)
                length = np.diff(np.append(run, len(string)))
                item = earliest[at[own[string[run]]]]
                found.append((ids[item], keys[item], start[item] + offset[run], start[item] + offset[run] + length + WINDOW - 1))
        family.clear()

    for (lo, hi), more in zip(cut, linked, strict=True):
        if not more:
            flush()
        own = np.arange(lo, hi)
        items = earliest[at[own]]
        family.append((Shard([strings[i] for i in at[own].tolist()], ids[items], start[items]), own))
    flush()
    yield from found


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(plain(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            gone = runs(spans)
            edges = [0, *(x for run in gone for x in run), len(text)]
            rows.append((len(text), sum(b - a for a, b in gone), gone, b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])))
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in r[2]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array([r[3] for r in rows], pa.binary())]
        yield pa.record_batch([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "removed", "kept"])


def dedup_bytes(docs: DataFrame, buckets: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (maximal spans of bytes), kept (the bytes left)."""
    found = with_spans(docs, repeated_spans(docs, _spread, lambda payloads: _settle(payloads, shard_bytes), buckets))
    return found.mapInArrow(_kept, "doc_id bigint, n_bytes bigint, n_removed bigint, removed array<struct<start:bigint,stop:bigint>>, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES: dict[str, str] = {}
