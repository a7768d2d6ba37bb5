"""Operator 12, alignment of two tokenizers' tokens, and how many documents hold each linked pair of ids.

1. A text parts at single spaces between other characters, where neither tokenizer has a token across. A block of
   documents becomes its distinct parts, each encoded once; a part's tokens end where the cumulative sums of their
   bytes say. Ends common to both (``intersect1d``) cut the tokens into groups (``searchsorted``); links, the pairs of
   tokens whose byte ranges overlap, come from expansion by ``repeat``. What a document has is the sum over its parts.
   Blocks are written to the shared folder, so each text is encoded once.
2. Each block lists the pairs it holds, with its number of documents for each, dealt by the pair's first id. Sums
   are made in two stages: of a bucket's lists by salt, then of a bucket. A bucket then knows each pair's count, and
   of each first id the highest.
3. Each list meets its bucket's table once more, under the same salts, and gets counts and marks back, which the
   block adds up for its documents.

Texts that either tokenizer changes have no tokens. Where that happens to a part, the whole text is encoded as one.

Defined results: a null or empty text has no tokens; repeated rows count as documents of their own and each get a
row; a null doc_id stays null; very long texts are encoded whole, as a block of their own; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidelake.llm.bpe_codec import pieces
from tidelake.llm.common import documents, materialised, text_of
from tidelake.llm.superkmer import mixed, packed, unpacked

#: A block of documents: so many bytes of text, or one longer document.
BLOCK_BYTES = 4_000_000
#: Bytes of aligned parts that a task remembers; beyond, it starts anew, and a part met again is encoded again.
KNOWN_BYTES = 150_000_000
#: Characters of parts that are encoded and aligned at once.
ENCODE_CHARS = 200_000
#: Buckets of pairs by first id. Their number needs no growth: the vocabularies bound the pairs.
BUCKETS = 256
#: Lists of a bucket that meet under one salt.
LISTS_PER_SALT = 64

_ODD_SPACE = re.compile(r"\s\s|^\s|\s$")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")

BLOCK_SCHEMA = "block string, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, sha array<string>, parts binary, pairs binary"


class Tokenizers:
    """Both tokenizers, and the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.bytes_a = pieces(path_a)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        #: Whether texts may be parted at spaces: no token of B goes on after one.
        self.parts = not any("▁" in x.lstrip("▁") for x in names)

    def split(self, text: str) -> list[str]:
        if not self.parts:
            return [text]
        return _SAFE_SPACE.split(text) if _ODD_SPACE.search(text) else text.split(" ")

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All parts' ids by A, with a space before each part, how many each has, and the same by B."""
        out = []
        for ids in ([e.ids for e in self.a.encode_batch_fast([" " + x for x in parts], add_special_tokens=False)], self.b.encode(parts, num_threads=1)):
            out += [np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))]
        return tuple(out)


def _kept(ids: np.ndarray, counts: np.ndarray, stays: np.ndarray) -> np.ndarray:
    return ids[np.repeat(stays, counts)]


class Alignment:
    """Groups and links of distinct parts. What has no tokens (``ok`` false) counts nothing."""

    def __init__(self, tok: Tokenizers, parts: list[str]):
        ids_a, n_a, ids_b, n_b = tok.encode(parts)
        self.ok = self._unchanged(tok, parts, ids_a, n_a, ids_b, n_b)
        ids_a, ids_b = _kept(ids_a, n_a, self.ok), _kept(ids_b, n_b, self.ok)
        self.n_a, self.n_b = np.where(self.ok, n_a, 0), np.where(self.ok, n_b, 0)
        ends_a, ends_b = np.cumsum(tok.sizes_a[ids_a]), np.cumsum(tok.sizes_b[ids_b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        owner_a, owner_b = np.repeat(np.arange(len(parts)), self.n_a), np.repeat(np.arange(len(parts)), self.n_b)
        self.n_groups = np.bincount(owner_a[np.searchsorted(ends_a, cuts)], minlength=len(parts))
        # of each token of A, the tokens of B that overlap it: from the one that ends after its start to the one that starts before its end
        first = np.searchsorted(ends_b, ends_a - tok.sizes_a[ids_a], "right")
        count = np.searchsorted(ends_b - tok.sizes_b[ids_b], ends_a, "left") - first
        at_a = np.repeat(np.arange(len(ids_a)), count)
        at_b = _ranges(first, count)
        self.link_pair = ids_a[at_a] << 32 | ids_b[at_b]
        self.n_links = np.bincount(owner_a[at_a], minlength=len(parts))  # links come by part
        self.texts = self._written(ids_a, group_a, owner_a, ids_b, group_b, owner_b, len(parts))

    @staticmethod
    def _unchanged(tok: Tokenizers, parts: list[str], ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Which parts' tokens give the part's own bytes back, by either tokenizer."""
        want = [b" " + x.encode() for x in parts]
        ok = np.ones(len(parts), bool)
        for ids, counts, table, sizes in ((ids_a, n_a, tok.bytes_a, tok.sizes_a), (ids_b, n_b, tok.bytes_b, tok.sizes_b)):
            till, ends = np.append(0, np.cumsum(sizes[ids])), np.cumsum(counts)
            got = b"".join(map(table.__getitem__, ids.tolist()))
            if got != b"".join(want) or (till[ends] - till[ends - counts] != [len(x) for x in want]).any():
                ok &= [got[till[e - n] : till[e]] == x for e, n, x in zip(ends.tolist(), counts.tolist(), want, strict=True)]
        return ok

    @staticmethod
    def _written(ids_a: np.ndarray, group_a: np.ndarray, owner_a: np.ndarray, ids_b: np.ndarray, group_b: np.ndarray, owner_b: np.ndarray, n: int) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each part."""
        side = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(side, kind="stable")
        side, ids, owner = side[order], np.concatenate([ids_a, ids_b])[order], np.concatenate([owner_a, owner_b])[order]
        step = np.append(side[1:] - side[:-1], 0)  # 0: same list, 1: from A to B or to the next group
        last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
        marks = np.where(last, 3, np.where(step == 0, 0, np.where(side % 2 == 0, 1, 2)))
        tokens = [f"{i}{m}" for i, m in zip(ids.tolist(), np.array([",", "|", ";", ""])[marks].tolist(), strict=True)]
        edges = np.searchsorted(owner, np.arange(n + 1)).tolist()
        return ["".join(tokens[a:b]) for a, b in pairwise(edges)]


class Table:
    """The parts that a task has aligned: their numbers, groups as text, and links end to end."""

    NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "ok")

    def __init__(self, path_a: str, path_b: str):
        self.tok = Tokenizers(path_a, path_b)
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.texts: list[str] = []
        self.link_pair = np.zeros(0, np.int64)
        self.numbers = {k: np.zeros(0, np.int64) for k in self.NUMBERS}
        self.held = 0

    def rows(self, parts: list[str]) -> np.ndarray:
        """The row of each distinct part; new ones are aligned first."""
        found, new, room = [], [], 0
        for part in (*(x for x in parts if x not in self.row), None):
            if part is None or room > ENCODE_CHARS:
                if new:
                    found.append(Alignment(self.tok, new))
                    self.row.update(zip(new, range(len(self.texts), len(self.texts) + len(new)), strict=True))
                    self.texts += found[-1].texts
                    self.held += sum(260 + 4 * len(x) for x in new)
                new, room = [], 0
            if part is not None:
                new.append(part)
                room += len(part)
        self.link_pair = np.concatenate([self.link_pair, *(x.link_pair for x in found)])
        self.numbers = {k: np.concatenate([v, *(getattr(x, k).astype(np.int64) for x in found)]) for k, v in self.numbers.items()}
        return np.fromiter((self.row[x] for x in parts), np.int64, len(parts))


@lru_cache(maxsize=1)
def table(path_a: str, path_b: str) -> Table:
    return Table(path_a, path_b)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, ``count`` numbers."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - first, count)


def _bucket(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed((pairs >> 32).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _coded(parts: list[list[str]]) -> tuple[list[str], np.ndarray]:
    coded = pa.array([x for part in parts for x in part], pa.large_string()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _block(name: str, ids: pa.Array, texts: list[str | None], known: Table, buckets: int) -> pa.RecordBatch:
    if known.held > KNOWN_BYTES:
        known.clear()
    split = [known.tok.split(x) if x else [] for x in texts]
    distinct, at = _coded(split)
    rows = known.rows(distinct)
    counts = np.fromiter(map(len, split), np.int64, len(split))
    ok = known.numbers["ok"][rows] > 0
    if not ok.all():  # documents with a part that doesn't come back: their whole texts decide
        for k in np.unique(np.repeat(np.arange(len(split)), counts)[~ok[at]]).tolist():
            whole = known.rows([texts[k]])
            split[k] = [texts[k]] if known.numbers["ok"][whole[0]] else []
        distinct, at = _coded(split)
        rows = known.rows(distinct)
        counts = np.fromiter(map(len, split), np.int64, len(split))
    docs = np.repeat(np.arange(len(split)), counts)
    edges = np.append(0, np.cumsum(counts))
    sums = []
    for what in ("n_a", "n_b", "n_groups", "n_links"):
        till = np.append(0, np.cumsum(known.numbers[what][rows][at]))
        sums.append(till[edges[1:]] - till[edges[:-1]])
    written = [known.texts[k] for k in rows.tolist()]
    sha = []
    for a, b in pairwise(edges.tolist()):
        sha.append(hashlib.sha256(";".join([written[k] for k in at[a:b].tolist()]).encode()).hexdigest() if b > a else "")
    del split, written
    # the block's parts are numbered by frequency, so that most numbers are small
    by_count = np.argsort(-np.bincount(at, minlength=len(rows)), kind="stable")
    rank = np.empty(len(by_count), np.int64)
    rank[by_count] = np.arange(len(by_count))
    rows, at = rows[by_count], rank[at]
    n_links = known.numbers["n_links"][rows]
    first = (np.cumsum(known.numbers["n_links"]) - known.numbers["n_links"])[rows]
    # its pairs by bucket, and how many of its documents hold each
    link_pair = known.link_pair[_ranges(first, n_links)]
    pairs = _distinct(link_pair)
    of_link = np.searchsorted(pairs, link_pair)
    order = np.argsort(_bucket(pairs, buckets), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    pairs, of_link = pairs[order], place[of_link]
    doc, part = np.divmod(_distinct(docs * max(1, len(rows)) + at), max(1, len(rows)))
    n = n_links[part]
    link = _ranges((np.cumsum(n_links) - n_links)[part], n)
    in_docs = np.bincount(_distinct(np.repeat(doc, n) * max(1, len(pairs)) + of_link[link]) % max(1, len(pairs)), minlength=len(pairs))
    of_parts = packed([], 3, counts=counts, at=at, n_links=n_links, of_link=of_link)
    of_pairs = packed([], 3, pairs=pairs, docs=in_docs)
    edge = pa.array([0, len(counts)], pa.int32())
    lists = [pa.ListArray.from_arrays(edge, x) for x in (ids, *(pa.array(x, pa.int64()) for x in sums), pa.array(sha, pa.string()))]
    return pa.record_batch([pa.array([name]), *lists, pa.array([of_parts], pa.binary()), pa.array([of_pairs], pa.binary())], ["block", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "sha", "parts", "pairs"])


def _blocks(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, buckets: int) -> Iterator[pa.RecordBatch]:
    known, partition, made = table(path_a, path_b), TaskContext.get().partitionId(), 0
    for batch in batches:
        total, a = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + BLOCK_BYTES, "right")))
            yield _block(f"{partition}-{made}", batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a).to_pylist(), known, buckets)
            made, a = made + 1, b


def _lists(batches: Iterator[pa.RecordBatch], buckets: int, salts: int) -> Iterator[pa.RecordBatch]:
    """A block's pairs as one list for each bucket."""
    for batch in batches:
        for block, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            columns = unpacked(blob, "pairs", "docs")[2]
            ends = np.searchsorted(_bucket(columns["pairs"], buckets), np.arange(buckets), "right")
            begins = np.append(0, ends[:-1])
            full = np.flatnonzero(ends > begins)
            blobs = [packed([], 3, **{k: x[begins[f] : ends[f]] for k, x in columns.items()}) for f in full.tolist()]
            # any fixed deal of blocks to salts will do
            salt = int.from_bytes(hashlib.blake2b(block.encode(), digest_size=4).digest(), "little") % salts
            yield pa.record_batch([pa.array(full, pa.int32()), pa.array([salt] * len(full), pa.int32()), pa.array([block] * len(full), pa.string()), pa.array(blobs, pa.binary())], ["bucket", "salt", "block", "list"])


def _summed(pairs: list[np.ndarray], docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, which = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, which, np.concatenate(docs))
    return keys, total


def _sums(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sums lists that come sorted by their first ``keys`` columns. What is held is folded whenever it has doubled."""
    now, held, size, folded = None, ([], []), 0, 0

    def out() -> pa.RecordBatch:
        pairs, docs = _summed(*held)
        return pa.record_batch([*(pa.array([k], pa.int32()) for k in now), pa.array([packed([], 3, pairs=pairs, docs=docs)], pa.binary())], [*("bucket", "salt")[:keys], "list"])

    for batch in batches:
        for *key, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now and now is not None:
                yield out()
                held, size, folded = ([], []), 0, 0
            now = key
            columns = unpacked(blob, "pairs", "docs")[2]
            held[0].append(columns["pairs"])
            held[1].append(columns["docs"])
            size += len(columns["pairs"])
            if size > 2 * folded + 100_000:
                pairs, docs = _summed(*held)
                held, size, folded = ([pairs], [docs]), len(pairs), len(pairs)
    if now is not None:
        yield out()


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and salt, each time the bucket's table first: then lists get count and mark of their pairs."""
    pairs = docs = best = np.zeros(0, np.int64)
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for bucket, _, block, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            columns = unpacked(blob, "pairs", "docs")[2]
            if block is None:
                pairs, docs = columns["pairs"], columns["docs"]
                first = np.flatnonzero(np.append(True, pairs[1:] >> 32 != pairs[:-1] >> 32))
                best = docs == np.repeat(np.maximum.reduceat(docs, first), np.diff(np.append(first, len(pairs))))
                continue
            at = np.searchsorted(pairs, columns["pairs"])
            for k, x in enumerate((block, bucket, packed([], 3, count=docs[at], best=best[at].astype(np.int64)))):
                out[k].append(x)
        yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["block", "bucket", "answer"])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_ids", "n_a", "n_b", "n_groups", "n_links", "sha"]
    for batch in batches:
        for k in range(len(batch)):
            row = batch.slice(k, 1)
            parts = unpacked(row["parts"][0].as_py(), "counts", "at", "n_links", "of_link")[2]
            lists = [unpacked(x["answer"], "count", "best")[2] for x in sorted(row["answers"][0].as_py() or [], key=lambda x: x["bucket"])]
            docs = np.repeat(np.arange(len(parts["counts"])), parts["counts"])
            sums = []
            for what in ("best", "count"):
                of_link = np.concatenate([x[what] for x in lists])[parts["of_link"]] if lists else np.zeros(0, np.int64)
                till = np.append(0, np.cumsum(of_link))
                ends = np.cumsum(parts["n_links"])
                of_part = till[ends] - till[ends - parts["n_links"]]
                total = np.append(0, np.cumsum(of_part[parts["at"]]))  # exact in 64 bits
                edges = np.append(0, np.cumsum(parts["counts"]))
                sums.append(pa.array(total[edges[1:]] - total[edges[:-1]], pa.int64()))
            yield pa.record_batch([*(row[n].flatten() for n in names), *sums], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])


def align(docs: DataFrame, path_a: str, path_b: str, buckets: int = BUCKETS, lists_per_salt: int = LISTS_PER_SALT) -> tuple[DataFrame, DataFrame]:
    """Per document its tokens, groups, links and what the pairs' counts say of them; and the table of pairs (``pair_counts`` reads it).

    ``path_a``: a byte-level BPE file of the tokenizers library; ``path_b``: a sentencepiece model that puts a space first.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    blocks = materialised(rows.mapInArrow(lambda it: _blocks(it, path_a, path_b, buckets), BLOCK_SCHEMA))
    salts = max(1, -(-blocks.count() // lists_per_salt))
    lists = blocks.select("block", "pairs").mapInArrow(lambda it: _lists(it, buckets, salts), "bucket int, salt int, block string, list binary")
    by_salt = lists.select("bucket", "salt", "list").repartition(partitions, "bucket", "salt").sortWithinPartitions("bucket", "salt")
    partial = by_salt.mapInArrow(lambda it: _sums(it, 2), "bucket int, salt int, list binary").select("bucket", "list")
    by_bucket = partial.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    tables = materialised(by_bucket.mapInArrow(lambda it: _sums(it, 1), "bucket int, list binary"))
    salted = tables.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("string").alias("block"), "list")
    met = lists.unionByName(salted).repartition(partitions, "bucket", "salt").sortWithinPartitions("bucket", "salt", F.col("block").asc_nulls_first())
    answers = met.mapInArrow(_answers, "block string, bucket int, answer binary").groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
    joined = blocks.drop("pairs").join(answers.hint("merge"), "block", "left")
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    return joined.mapInArrow(_assembled, schema), tables


def pair_counts(tables: DataFrame) -> DataFrame:
    """id_a, id_b and n_docs, how many documents hold the pair linked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                columns = unpacked(blob, "pairs", "docs")[2]
                yield pa.record_batch([columns["pairs"] >> 32, columns["pairs"] & 0xFFFFFFFF, columns["docs"]], ["id_a", "id_b", "n_docs"])

    return tables.select("list").mapInArrow(rows, "id_a bigint, id_b bigint, n_docs bigint")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned, _ = align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op12_token_alignment": op12_token_alignment}
ORACLES: dict[str, str] = {}
