"""Operator 3, BPE encoding and decoding through a distinct-word table.

1. Spark splits every text into words (the tokenizer's own pre-token expression).
2. A block of documents becomes its distinct words, dealt by hash into ``buckets`` packed lists, and
   the positions of these words. Lists and positions are made by two passes over the documents, since
   writing positions down and moving them would cost the input's size twice. A block's name holds a
   hash of what it was made from; if the two passes should ever see rows in different order, names
   don't meet and the job fails, rather than giving wrong ids.
3. The lists of one bucket, from all blocks, meet in one place: the distinct-word table. Each distinct
   word is encoded once there, and the ids of each list go back to its block.
4. Per block the ids are put at the words' positions. Decoding joins ids to the vocabulary's pieces
   (a table of fixed size) and concatenates them.

Texts with characters that Java's Unicode tables don't know, or with a special token's own text, are
split by the tokenizers library instead of by Spark; they go the same way from there.

Defined results: a null text counts as empty and has no ids; repeated rows each get a row; a null
doc_id stays null; very long texts are encoded whole, as a block of their own; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelake.llm.common import documents, text_of

# Fixed value: the public byte-level pre-token expression, in Java's syntax.
SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of words and ids that a task's table holds before it starts anew; a word met again is encoded again.
TABLE_BYTES = 200_000_000

LISTS_SCHEMA = "block string, bucket int, words binary"
POSITIONS_SCHEMA = "block string, doc_ids array<bigint>, n_words array<int>, positions binary"


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_texts(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(x["content"] for x in json.load(f)["added_tokens"])


def byte_of_character() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def pieces(path: str) -> list[bytes]:
    """The id-to-piece table: the bytes of each id."""
    tok, table = tokenizer(path), byte_of_character()
    special = set(special_texts(path))
    out = []
    for i in range(tok.get_vocab_size(with_added_tokens=True)):
        piece = tok.id_to_token(i) or ""
        known = piece not in special and all(c in table for c in piece)
        out.append(bytes(table[c] for c in piece) if known else piece.encode())
    return out


def _packed(values: pa.Array) -> bytes:
    """A list of words, or of id lists, as one compressed Arrow column."""
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([values], ["x"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Array:
    return pa.ipc.open_stream(blob).read_all().column(0).combine_chunks()


def _planes(values: np.ndarray) -> bytes:
    """Positions as byte planes, which compress well when small numbers prevail."""
    return zstandard.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unplanes(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def split_words(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, words; by_library holds the text where the library has to split it."""
    text = text_of()
    odd = F.regexp_like(text, F.lit(r"\p{Cn}"))
    for special in special_texts(path):
        odd = odd | F.contains(text, F.lit(special))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), odd.alias("odd"))
    words = F.when(F.col("odd"), F.array().cast("array<string>")).otherwise(F.regexp_extract_all("text", F.lit(SPLIT), F.lit(0)))
    return rows.select("doc_id", words.alias("words"), F.when(F.col("odd"), F.col("text")).alias("by_library"))


def library_words(text: str, path: str) -> list[str]:
    """The library's own split: special tokens first, then pre-tokens."""
    tok, parts = tokenizer(path), [text]
    for special in special_texts(path):
        parts = [y for x in parts for i, z in enumerate(x.split(special) if x != special else [x]) for y in ([special, z] if i else [z])]
    return [w for p in parts for w in ([p] if p in special_texts(path) else [p[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(p)])]


def _blocks(batches: Iterator[pa.RecordBatch], path: str, buckets: int, block_words: int, lists: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of whole documents: with ``lists`` their distinct words by bucket, else the positions of these."""
    partition, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, words, odd = batch.column(0), batch.column(1), batch.column(2)
        if odd.null_count < len(odd):
            own = [words[i].as_py() if odd[i].as_py() is None else library_words(odd[i].as_py(), path) for i in range(len(odd))]
            words = pa.array(own, pa.list_(pa.string()))
        counts = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        total, a = np.cumsum(counts), 0
        while a < len(counts):  # up to block_words words together, or one longer document
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + block_words, "right")))
            coded = words.slice(a, b - a).flatten().dictionary_encode()
            distinct, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            texts = distinct.to_pylist()
            name = f"{partition}-{made}-{zlib.crc32(at.tobytes(), zlib.crc32(repr(ids.slice(a, b - a).to_pylist()).encode())):08x}-{zlib.crc32(' '.join(texts).encode()):08x}"
            made += 1
            # crc32 deals a word to the same bucket wherever it is met
            bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in texts), np.int64, len(distinct))
            order = np.argsort(bucket, kind="stable")
            if lists:
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                ordered, full = distinct.take(pa.array(order)), np.flatnonzero(np.diff(ends))
                blobs = [_packed(ordered.slice(ends[k], ends[k + 1] - ends[k])) for k in full.tolist()]
                yield pa.record_batch([pa.array([name] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], ["block", "bucket", "words"])
            else:
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                # words are numbered by frequency, so that most numbers are small; their places in the lists come first
                by_count = np.argsort(-np.bincount(at, minlength=len(distinct)), kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[by_count] = np.arange(len(order))
                blob = _planes(np.concatenate([[len(order)], place[by_count], rank[at]]))
                edge = pa.array([0, b - a], pa.int32())
                yield pa.record_batch([pa.array([name]), pa.ListArray.from_arrays(edge, ids.slice(a, b - a)), pa.ListArray.from_arrays(edge, pa.array(counts[a:b], pa.int32())), pa.array([blob], pa.binary())], ["block", "doc_ids", "n_words", "positions"])
            a = b


def _encode_lists(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The distinct-word table of the buckets that meet here. A word met before is looked up."""
    tok, known, held = tokenizer(path), {}, 0
    for batch in batches:
        out = []
        for blob in batch.column(2).to_pylist():
            words = _unpacked(blob).to_pylist()
            if held > TABLE_BYTES:
                known, held = {}, 0
            new = [w for w in words if w not in known]
            held += sum(200 + 5 * len(w) for w in new)  # with what Python adds
            known.update(zip(new, (np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(new, add_special_tokens=False)), strict=True))
            out.append(_packed(pa.array([known[w] for w in words], pa.binary())))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["block", "bucket", "ids"])


def _assemble(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table = pieces(path)
    for batch in batches:
        for row in batch.to_pylist():
            lists = sorted((x["bucket"], x["ids"]) for x in row["encoded"] or [])
            by_place = [ids for _, blob in lists for ids in _unpacked(blob).to_pylist()]
            stored = _unplanes(row["positions"])
            n = int(stored[0])
            if n != len(by_place):
                raise RuntimeError(f"block {row['block']} was read in another order: materialise the documents first")
            ids = [by_place[p] for p in stored[1 : n + 1].tolist()]
            text = [b"".join([table[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in ids]
            at, start = stored[n + 1 :], 0
            parts: tuple[list, list, list] = ([], [], [])
            for k, count in enumerate(row["n_words"]):
                own = at[start : start + count].tolist()
                start += count
                parts[0].append(row["doc_ids"][k])
                parts[1].append(b"".join([ids[i] for i in own]))
                parts[2].append(b"".join([text[i] for i in own]).decode("utf-8", "replace"))
                if k % 500 == 499 or k + 1 == len(row["n_words"]):
                    yield pa.record_batch([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.binary()), pa.array(parts[2], pa.string())], ["doc_id", "ids", "decoded"])
                    parts = ([], [], [])


def encode_and_decode(docs: DataFrame, path: str, buckets: int | None = None, block_words: int = 4_000_000) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), decoded text. ``path``: a byte-level BPE file of the tokenizers library."""
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = split_words(docs, path)
    lists = words.mapInArrow(lambda it: _blocks(it, path, buckets, block_words, True), LISTS_SCHEMA)
    encoded = lists.repartition(buckets, "bucket").mapInArrow(lambda it: _encode_lists(it, path), "block string, bucket int, ids binary")
    back = encoded.groupBy("block").agg(F.collect_list(F.struct("bucket", "ids")).alias("encoded"))
    positions = words.mapInArrow(lambda it: _blocks(it, path, buckets, block_words, False), POSITIONS_SCHEMA)
    joined = positions.join(back.hint("merge"), "block", "left")
    return joined.mapInArrow(lambda it: _assemble(it, path), "doc_id bigint, ids binary, decoded string")


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_and_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op3_bpe_codec": op3_bpe_codec}
ORACLES: dict[str, str] = {}
