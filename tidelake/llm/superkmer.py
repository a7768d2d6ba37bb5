"""Super-k-mers: the way by which equal windows of different documents meet.

The smallest hashed m-mer of a window (its minimiser, the leftmost one among equals) depends on the
window's content alone. Consecutive windows with one minimiser travel as one packed string to the
bucket of that minimiser, so that equal windows always meet, and each text moves a few times its size,
whatever the window's length.

A block of documents first settles what it can: of a string that it holds several times only the
earliest occurrence travels; the later ones are already known to repeat. A string that a third of all
documents share thus arrives once per block.

Rows are identified by (doc_id, hash of the text), so that repeated rows share their result. A null
doc_id ranks after all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import text_of

#: A block of documents: so many bytes of text, or one longer document.
BLOCK_BYTES = 5_000_000
#: Bytes of the table, as Spark estimates them from its files, for each bucket; unpacked, a bucket's strings take several times as much.
BUCKET_BYTES = 4_000_000
NO_ID = np.iinfo(np.int64).max
SHIPPED, SETTLED = 0, 1


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def minimiser_runs(hashes: np.ndarray, per_window: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive valid windows with the same minimiser: (first window, windows, place of the minimiser).

    ``hashes`` has one entry per m-mer, ``valid`` says which window starts count; window i sees m-mers i to i + per_window - 1.
    """
    n = len(valid)
    place_bits = np.uint64(24)
    low = np.uint64((1 << 24) - 1)
    least = np.arange(len(hashes), dtype=np.uint64)
    least &= low
    least |= hashes & ~low
    width = 1
    while width * 2 <= per_window:
        least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
        width *= 2
    rest = per_window - width
    least = np.minimum(least[: len(least) - rest], least[rest:])[:n] if len(least) > rest else least[:0]
    at = np.flatnonzero(valid[: len(least)])
    if not len(at):
        return at, at, at
    # places wrap every 2^24 m-mers; a window is shorter by far
    place = at + ((least[at] & low).astype(np.int64) - at) % (1 << int(place_bits))
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), place[first]


def packed(strings: list[bytes], level: int = 6, **numbers: np.ndarray) -> bytes:
    """Strings and columns of numbers in one compressed parcel. Numbers go as byte planes, most of which are empty."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    columns = [sizes, *numbers.values()]
    head = np.array([len(x) for x in columns], "<i8").tobytes()
    return zstandard.compress(head + b"".join([x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in columns]) + b"".join(strings), level)


def unpacked(parcel: bytes, *names: str) -> tuple[np.ndarray, bytes, dict[str, np.ndarray]]:
    """Sizes of the strings, the strings end to end, and the columns of numbers."""
    data = zstandard.decompress(parcel)
    counts, at, columns = np.frombuffer(data, "<i8", 1 + len(names)), 8 * (1 + len(names)), []
    for n in counts.tolist():
        columns.append(np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, -1).T.copy().view("<i8").ravel() if n else np.zeros(0, np.int64))
        at += 8 * n
    return columns[0], data[at:], dict(zip(names, columns[1:], strict=True))


def opened(parcels: list[bytes], *names: str) -> tuple[pa.Array, dict[str, np.ndarray]]:
    """Several parcels as one: their strings as an Arrow column, and their numbers."""
    parts = [unpacked(x, *names) for x in parcels]
    sizes = np.concatenate([p[0] for p in parts])
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)  # a bucket may pass 2 GB
    strings = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join([p[1] for p in parts]))])
    return strings, {k: np.concatenate([p[2][k] for p in parts]) for k in names}


class Block:
    """Some whole documents: their bytes end to end, and for each its edges, id and text hash."""

    def __init__(self, batch: pa.RecordBatch):
        text = batch.column(2)
        wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)  # as the session's Arrow settings are
        offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = text.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.edges = offsets - offsets[0]
        self.ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.keys = batch.column(1).to_numpy(zero_copy_only=False)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        total, start = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while start < len(batch):
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + BLOCK_BYTES, "right")))
            yield Block(batch.slice(start, stop - start))
            start = stop


def shipped_rows(parcels: list[tuple[int, bytes]], settled: dict[str, np.ndarray], salt: int) -> pa.RecordBatch:
    """What a block sends: a parcel for each bucket, and what it has settled itself to any bucket."""
    rows = [(bucket, SHIPPED, parcel) for bucket, parcel in parcels]
    if len(settled["start"]):
        settled = _merged(**settled)
        rows.append((salt, SETTLED, packed([], **settled)))
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "payload"])


def _merged(doc_id: np.ndarray, text_key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> dict[str, np.ndarray]:
    """Spans that overlap or touch, made one. A document's spans get longer with their start."""
    order = np.lexsort((start, text_key, doc_id))
    doc_id, text_key, start, stop = doc_id[order], text_key[order], start[order], stop[order]
    new = np.append(True, (doc_id[1:] != doc_id[:-1]) | (text_key[1:] != text_key[:-1]) | (start[1:] > stop[:-1]))
    first = np.flatnonzero(new)
    return {"doc_id": doc_id[first], "text_key": text_key[first], "start": start[first], "stop": np.maximum.reduceat(stop, first)}


def _by_bucket(batches: Iterator[pa.RecordBatch], settle: Callable[[list[bytes]], dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket. What blocks have settled passes through."""

    def out(found: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(found["start"]), 100_000):
            ids = found["doc_id"][a : a + 100_000]
            arrays = [pa.array(ids, pa.int64(), mask=ids == NO_ID), *(pa.array(found[k][a : a + 100_000], pa.int64()) for k in ("text_key", "start", "stop"))]
            yield pa.record_batch(arrays, ["doc_id", "text_key", "start", "stop"])

    held: list[bytes] = []
    now = None
    for batch in batches:
        for bucket, kind, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == SETTLED:
                yield from out(unpacked(payload, "doc_id", "text_key", "start", "stop")[2])
                continue
            if bucket != now and held:
                yield from out(settle(held))
                held = []
            now = bucket
            held.append(payload)
    if held:
        yield from out(settle(held))


def identified(docs: DataFrame) -> DataFrame:
    """The text, and its hash of 64 bits, which tells rows of one doc_id apart (all rows without one, too)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_key"), text_of().alias("text"))


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for batch in batches:
        for a in range(0, len(batch), 500):
            ids, keys, texts = batch.slice(a, 500).columns
            yield pa.record_batch([ids, keys, pa.array([squeeze.compress(x) for x in texts.cast(pa.binary()).to_pylist()], pa.binary())], ["doc_id", "text_key", "text"])


def table_bytes(docs: DataFrame) -> int:
    """The optimiser's estimate of a table's size; 0 where its source can't tell."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def repeated_spans(docs: DataFrame, spread: Callable, settle: Callable, buckets: int | None = None) -> DataFrame:
    """doc_id, text_key and spans, an array of (start, stop) of what repeats, for the documents that have any.

    Buckets are as many as BUCKET_BYTES of the table's size ask for, four for each shuffle partition at least.
    ``spread(blocks, buckets)`` turns blocks into shipped rows, ``settle(payloads)`` finds the repeats of a bucket.
    """
    buckets = buckets or max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), table_bytes(docs) // BUCKET_BYTES)
    sent = identified(docs).mapInArrow(lambda it: spread(blocks(it), buckets), "bucket int, kind int, payload binary")
    met = sent.repartition(max(1, buckets // 4), "bucket").sortWithinPartitions("bucket")
    spans = met.mapInArrow(lambda it: _by_bucket(it, settle), "doc_id bigint, text_key bigint, start bigint, stop bigint")
    return spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text (compressed, to move it) and spans of every document; ``plain`` reads the text."""
    rows = identified(docs).mapInArrow(_compressed, "doc_id bigint, text_key bigint, text binary")
    found = spans.select(F.col("doc_id").alias("span_id"), F.col("text_key").alias("span_key"), "spans")
    same = rows["doc_id"].eqNullSafe(found["span_id"]) & (rows["text_key"] == found["span_key"])
    return rows.join(found.hint("merge"), same, "left").select("doc_id", "text", "spans")


def plain(texts: pa.Array) -> Iterator[bytes]:
    expand = zstandard.ZstdDecompressor()
    return (expand.decompress(x) for x in texts.to_pylist())


def runs(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted maximal runs covered by the spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
