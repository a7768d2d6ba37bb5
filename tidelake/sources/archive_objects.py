"""Objects of a venue's archive as they lie in a store: LZ4 frames of JSON lines or CSV, one object for each hour or day.

Spark lists and reads the objects (any path that it can open); a task takes one object at a time, decodes its frame
block by block and gives the lines on in batches, so of an object only the compressed bytes are held whole. A frame
that ends early or holds something else is named, as an error or, if asked, in a column.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.sources import venue_json

#: Bytes that are decoded, and lines that are passed on, at once.
BLOCK_BYTES, LINES_PER_BATCH = 4 << 20, 20_000
#: Fixed value: how an LZ4 frame begins.
LZ4_MAGIC = b"\x04\x22\x4d\x18"

LINES = "object string, line_no bigint, value string, broken string"


class BrokenObject(ValueError):
    """An object whose frame can't be decoded to its end."""


def decoded_blocks(content: bytes) -> Iterator[bytes]:
    """Blocks of an LZ4 frame, or of several end to end; anything else is an error."""
    if not content.startswith(LZ4_MAGIC):
        raise OSError("not an LZ4 frame")
    with pa.CompressedInputStream(pa.BufferReader(content), "lz4") as frame:
        while block := frame.read(BLOCK_BYTES):
            yield bytes(block)


def _lines(content: bytes) -> Iterator[str]:
    rest = b""
    for block in decoded_blocks(content):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x.rstrip(b"\r").decode("utf-8") for x in whole)
    if rest:
        yield rest.rstrip(b"\r").decode("utf-8")


def _batches(name: str, content: bytes, strict: bool) -> Iterator[pa.RecordBatch]:
    start, held, broken = 0, [], None
    found = _lines(content)

    def out(values: list[str], note: str | None) -> pa.RecordBatch:
        n = len(values)
        return pa.record_batch([pa.array([name] * n, pa.string()), pa.array(range(start, start + n), pa.int64()), pa.array(values, pa.string()), pa.array([note] * n, pa.string())], ["object", "line_no", "value", "broken"])

    while True:
        try:
            held.append(next(found))
        except StopIteration:
            break
        except (OSError, UnicodeDecodeError) as e:
            if strict:
                raise BrokenObject(f"{name}: {e}") from e
            broken = str(e)
            break
        if len(held) == LINES_PER_BATCH:
            yield out(held, None)
            start, held = start + len(held), []
    yield out(held, None)
    start += len(held)
    if broken:
        yield out([None], broken)


def read_objects(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """Lines of LZ4 objects: (object, line_no, value, broken). Unless ``strict``, a broken object ends in a row without value that says why."""
    objects = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                yield from _batches(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), strict)

    return objects.mapInArrow(decode, LINES)


def write_objects(lines: DataFrame, path: str, name: str = "object") -> DataFrame:
    """Lines (value, in order of line_no) as LZ4 objects below ``path``, one for each ``name``: (object, n_lines) when run.

    ``path`` is of a store that pyarrow can open. An object is written under a name of its own and then moved into
    place, so a task that is run again replaces it whole.
    """
    rows = lines.select(F.col(name).alias("object"), F.col("line_no").cast("long"), "value")
    dealt = rows.repartition("object").sortWithinPartitions("object", "line_no")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        now, staged, sink, n = None, "", None, 0

        def closed() -> pa.RecordBatch:
            sink.close()
            store.move(staged, f"{root}/{now}")
            return pa.record_batch([pa.array([now]), pa.array([n], pa.int64())], ["object", "n_lines"])

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != now:
                    if sink:
                        yield closed()
                    now, n, staged = key, 0, f"{root}/{key}.{uuid.uuid4().hex}.tmp"
                    store.create_dir(staged.rpartition("/")[0], recursive=True)
                    sink = pa.CompressedOutputStream(store.open_output_stream(staged, compression=None), "lz4")
                sink.write((value or "").encode() + b"\n")
                n += 1
        if sink:
            yield closed()

    return dealt.mapInArrow(write, "object string, n_lines bigint")


def load_books(spark: SparkSession, path: str) -> DataFrame:
    """Order-book snapshots of archive objects."""
    return venue_json.l2_book(read_objects(spark, path).select("value"))


def load_fills(spark: SparkSession, path: str) -> DataFrame:
    """Fills of archive objects, one JSON document a line."""
    return venue_json.node_fills(read_objects(spark, path).select("value"))


#: Columns of contexts, under the archive's names.
_CONTEXTS = ("time", "coin", "funding", "open_interest", "oracle_px", "mark_px", "mid_px", "premium")


def load_contexts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Asset contexts of CSV objects; each object's first line is its header, of either style."""
    lines = read_objects(spark, path).filter(F.trim("value") != "").select("object", "line_no", F.split("value", ",").alias("cells"))
    headers = lines.filter("line_no = 0").select("object", F.col("cells").alias("names"))
    rows = lines.filter("line_no > 0").join(headers.hint("merge"), "object").withColumn("row", F.map_from_arrays("names", "cells"))
    api = {ours: theirs for theirs, ours in venue_json.CONTEXT_NAMES.items()}
    return venue_json.context_rows(rows.select(*[F.coalesce(F.col("row")[c], F.col("row")[api.get(c, c)]).alias(c) for c in _CONTEXTS]))
