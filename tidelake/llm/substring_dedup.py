"""Operator 8, substring dedup by super-k-mer partitioning over words.

A window is ``WINDOW`` consecutive words of one document. Windows travel as super-k-mers (see
``superkmer``) with minimisers of ``MINIMISER`` words, and in their bucket are ranked exactly by
sorting: ranks of 1 word are paired to ranks of 2, 4 and 8, and two overlapping ranks of 8 give the
window. Equal windows are removed wherever a document with a smaller doc_id has them too.

Defined results: a null, empty or white text has no words; repeats within one document, and between
rows of one doc_id, stay; a null doc_id counts as larger than all others; texts of fewer words than a
window stay whole; very long texts are read whole, as a block of their own; repeated rows each get a row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import documents
from tidelake.llm.superkmer import NO_ID, Block, minimiser_runs, mixed, opened, packed, plain, repeated_spans, runs, shipped_rows, with_spans

WINDOW, MINIMISER = 13, 2


class Words:
    """The words of a block: hashes and documents, and their bytes end to end."""

    def __init__(self, block: Block):
        b = block.bytes
        space = (b == 32) | ((b >= 9) & (b <= 13))
        first = ~space
        first[1:] &= space[:-1]
        edges = block.edges[:-1][block.edges[:-1] < len(b)]
        first[edges] = ~space[edges]
        starts = np.flatnonzero(first)
        self.count = len(starts)
        solid = b[~space]
        offsets = np.append(np.cumsum(~space, dtype=np.int64)[starts] - 1, len(solid)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), self.count, [None, pa.py_buffer(offsets), pa.py_buffer(solid)])
        coded = words.dictionary_encode()
        own = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        self.hashes = own[coded.indices.to_numpy()] if self.count else np.zeros(0, np.uint64)
        self.solid, self.offsets = solid, offsets
        self.doc = np.searchsorted(block.edges, starts, "right") - 1
        self.first_of_doc = np.searchsorted(self.doc, np.arange(len(block.ids)))


    def spaced(self) -> bytes:
        """Each word followed by one space: word i begins at offsets[i] + i."""
        out = np.full(len(self.solid) + self.count, 32, np.uint8)
        places = np.repeat(np.arange(self.count), np.diff(self.offsets)) + np.arange(len(self.solid))
        out[places] = self.solid
        return out.tobytes()


def _gathered(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs end to end: first[i], first[i] + 1, ... of each."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _spread(blocks: Iterator[Block], buckets: int) -> Iterator[pa.RecordBatch]:
    for block in blocks:
        w = Words(block)
        if w.count < WINDOW:
            continue
        h = mixed(w.hashes[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w.hashes[1:])
        first, windows, place = minimiser_runs(h, WINDOW - MINIMISER + 1, w.doc[: w.count - WINDOW + 1] == w.doc[WINDOW - 1 :])
        if not len(first):
            continue
        sizes = windows + WINDOW - 1
        doc, data, last = w.doc[first], w.spaced(), first + sizes - 1
        ids, start = block.ids[doc], first - w.first_of_doc[doc]
        strings = [data[a:b] for a, b in zip((w.offsets[first] + first).tolist(), (w.offsets[last + 1] + last).tolist(), strict=True)]
        code = pa.array(strings, pa.binary()).dictionary_encode().indices.to_numpy()
        least = np.full(code.max() + 1, NO_ID)
        np.minimum.at(least, code, ids)
        later = ids > least[code]
        settled = {"doc_id": ids[later], "text_key": block.keys[doc[later]], "start": start[later], "stop": start[later] + sizes[later]}
        go = np.flatnonzero(~later)
        bucket = (h[place[go]] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        go, bucket = go[order], bucket[order]
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(go)]
        parcels = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = go[a:b]
            parcels.append((int(bucket[a]), packed([strings[i] for i in own.tolist()], doc_id=ids[own], text_key=block.keys[doc[own]], start=start[own])))
        yield shipped_rows(parcels, settled, int(block.keys[0]) % buckets)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks."""
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1]


def _settle(payloads: list[bytes]) -> dict[str, np.ndarray]:
    column, numbers = opened(payloads, "doc_id", "text_key", "start")
    ids, keys, start = numbers.values()
    words = pc.split_pattern(column, b" ")
    sizes = words.value_lengths().to_numpy().astype(np.int64)
    rank = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    del column, words
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    first = np.cumsum(sizes) - sizes
    for step in (1, 2, 4):  # ranks of 2, 4, 8 words
        rank = _paired(rank[:-step], rank[step:])
    window = _gathered(first, sizes - WINDOW + 1)
    same = _paired(rank[window], rank[window + WINDOW - 8])
    of = owner[window]
    earliest = np.full(same.max() + 1, NO_ID)
    np.minimum.at(earliest, same, ids[of])
    hit = earliest[same] < ids[of]
    edge = of[1:] != of[:-1]
    opens, closes = hit.copy(), hit.copy()
    opens[1:] &= ~hit[:-1] | edge
    closes[:-1] &= ~hit[1:] | edge
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    item = of[a]
    at = start[item] + window[a] - first[item]
    return {"doc_id": ids[item], "text_key": keys[item], "start": at, "stop": at + (b - a) + WINDOW}


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(plain(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = text.split()  # of bytes: at ASCII white space alone
            gone = runs(spans)
            n_words.append(len(words))
            n_removed.append(sum(b - a for a, b in gone))
            for a, b in reversed(gone):
                del words[a:b]
            kept.append(b" ".join(words).decode())
        yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def dedup_windows(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    found = with_spans(docs, repeated_spans(docs, _spread, _settle, buckets))
    return found.mapInArrow(_kept, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_windows(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS first FROM x GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM x JOIN f USING (g) WHERE f.first < x.doc_id),
k AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce((SELECT string_agg(v, ' ' ORDER BY j) FROM (SELECT unnest(w) AS v, unnest(range(1, len(w) + 1)) AS j) WHERE gone IS NULL OR NOT list_contains(gone, j)), '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLES = {"op8_substring_dedup": ORACLE}
