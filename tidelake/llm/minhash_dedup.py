"""Operator 7, near-duplicates by SetSketch registers.

A document is the set of its hashed ``SHINGLE``-word shingles. Its sketch has ``BANDS`` x ``ROWS`` registers: of each
hash function the least value, read as an exponential variate and stored as its truncated logarithm to
base ``BASE``, so the sketch of a union is the registers' maximum.

1. Equal sets (by a cryptographic digest of the whole sorted set) are one class; its smallest document
   stands for it.
2. Bands of register values put classes into buckets. In a bucket every member is compared to the
   smallest one, its leader. At similarity 0.8 a pair misses all bands with probability (1 - 0.8^5)^32 < 4e-6.
3. The likelihood of the registers' order, given both set sizes, estimates the similarity; pairs
   estimated five standard deviations below the threshold drop out. The others are confirmed on the full sets.
4. Links give components. Where a bucket has members outside its leader's component, these are compared to
   all other members in blocks of full sets: one product of 0/1 matrices counts what all pairs of two blocks
   share. A cell of two blocks returns only links that join components, fewer than it has members. So no
   link between components of a bucket is lost, and pairs are never rows.

Defined results: null, empty and white texts have an empty set and no link; texts of fewer words than
a shingle are one shingle; a row without doc_id takes no part (component null, kept); rows of one
doc_id count as one document; repeated rows each get a row; very long texts are read whole, a text that
outgrows a block is a block by itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import documents, materialised
from tidelake.llm.components import connected_components
from tidelake.llm.substring_dedup import Words
from tidelake.llm.superkmer import Block, blocks, identified, mixed

SHINGLE, PERCENT = 4, 80
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base of the logarithm, rate, and largest register.
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Members and shingles of a bucket that make one block of full sets, and shingles that one matrix product counts.
BLOCK_MEMBERS, BLOCK_SHINGLES, PRODUCT_WIDTH = 1024, 400_000, 2048
#: Pairs of one leader that meet one copy of its row.
PAIRS_PER_COPY = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_random = np.random.default_rng(20240501)
_FACTORS = _random.integers(0, 1 << 32, (2, REGISTERS), dtype=np.uint32) | np.uint32(1)
_SHIFTS = _random.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def shingle_sets(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(document's place in the block, distinct shingle hashes), sorted."""
    block.bytes = _LOWER[block.bytes]
    w = Words(block)
    if not w.count:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    per_doc = np.bincount(w.doc, minlength=len(block.ids))
    few = (per_doc > 0) & (per_doc < SHINGLE)
    factors = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
    n = max(0, w.count - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = (h ^ (w.hashes[k : k + n] * factors[k])) * factors[0] + factors[1]
    valid = w.doc[:n] == w.doc[SHINGLE - 1 : SHINGLE - 1 + n] if n else np.zeros(0, bool)
    doc, h = w.doc[:n][valid], mixed(h[valid])
    if few.any():  # the whole sequence is one shingle
        own = np.flatnonzero(few)
        short = np.full(len(own), 77, np.uint64) + per_doc[own].astype(np.uint64)
        for k in range(SHINGLE - 1):
            has = per_doc[own] > k
            at = np.minimum(w.first_of_doc[own] + k, w.count - 1)
            short = np.where(has, mixed((short ^ w.hashes[at]) * factors[2]), short)
        doc, h = np.concatenate([doc, own]), np.concatenate([h, short])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def registers(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sketches of the sets that begin at ``starts``."""
    low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), REGISTERS), np.uint16)
    for j in range(REGISTERS):
        least = np.minimum.reduceat(low * _FACTORS[0, j] + high * _FACTORS[1, j] + _SHIFTS[j], starts)
        variate = -np.log1p(-(least + 0.5) / 4294967296.0) / RATE
        out[:, j] = np.clip(np.floor(1 - np.log(variate) / np.log(BASE)) + TOP // 2, 0, TOP + 1)
    return out


def estimated_similarity(k1: np.ndarray, k2: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from how many registers are larger, smaller and equal, given the set sizes."""
    larger, smaller = (k1 > k2).sum(1)[:, None], (k1 < k2).sum(1)[:, None]
    equal = k1.shape[1] - larger - smaller
    u = (n1 / (n1 + n2))[:, None]
    grid = np.linspace(0, 1, 101)[None, :]
    probability = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = probability(u - (1 - u) * grid), probability((1 - u) - u * grid)
    floor = 1e-9
    likelihood = larger * np.log(np.maximum(up, floor)) + smaller * np.log(np.maximum(down, floor)) + equal * np.log(np.maximum(1 - up - down, floor))
    likelihood = np.where(grid <= np.minimum(u / (1 - u), (1 - u) / u) + 1e-9, likelihood, -np.inf)
    return grid[0, likelihood.argmax(1)]


#: Estimates below this are five standard deviations under the threshold.
LEAST_ESTIMATE = PERCENT / 100 - 5 * (PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS) ** 0.5


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        doc, h = shingle_sets(block)
        n = np.bincount(doc, minlength=len(block.ids))
        has = np.flatnonzero(n)
        edges = np.append(0, np.cumsum(n))
        digest, sketch = [None] * len(n), [None] * len(n)
        if len(has):
            whole = h.astype("<u8").data
            for i, x in zip(has.tolist(), registers(h, edges[has]), strict=True):
                digest[i] = hashlib.sha256(whole[edges[i] : edges[i + 1]]).digest()[:16]
                sketch[i] = x.astype("<u2").tobytes()
        ids = pa.array(block.ids, mask=block.ids == np.iinfo(np.int64).max)
        yield pa.record_batch([ids, pa.array(n), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "class", "sketch"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        doc, h = shingle_sets(block)
        n = np.bincount(doc, minlength=len(block.ids))
        edges = np.append(0, np.cumsum(n)) * 8
        data = h.astype("<u8").tobytes()
        yield pa.record_batch([pa.array(block.ids), pa.array([data[a:b] for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], ["id", "members"])


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), REGISTERS)


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose estimate reaches LEAST_ESTIMATE."""
    for batch in batches:
        for start in range(0, len(batch), 20_000):
            a, b, level, n1, n2, s1, s2 = batch.slice(start, 20_000).columns
            keep = pa.array(estimated_similarity(_sketches(s1), _sketches(s2), n1.to_numpy(), n2.to_numpy()) >= LEAST_ESTIMATE)
            yield pa.record_batch([x.filter(keep) for x in (a, b, level)], ["a", "b", "level"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def _linked_pairs(sets: list[np.ndarray], block: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all linked pairs between components, and, of two blocks, between blocks."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    row = np.repeat(np.arange(len(sets)), size)
    column, met = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    common = met[column] > 1
    row, column = row[common], column[common]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    column = np.cumsum(np.append(0, np.diff(column) > 0)) if len(column) else column
    one = block == block.min()
    left = np.flatnonzero(one)
    right = left if one.all() else np.flatnonzero(~one)
    both, lo = np.zeros((len(left), len(right)), np.float32), 0
    while lo < len(column):  # shingles that occur once can't be shared
        hi = int(np.searchsorted(column, column[lo] + PRODUCT_WIDTH))
        there = np.zeros((len(sets), int(column[hi - 1] - column[lo]) + 1), np.float32)
        there[row[lo:hi], column[lo:hi] - column[lo]] = 1
        both += there[left] @ there[right].T
        lo = hi
    linked = 100 * both >= PERCENT * (size[left][:, None] + size[right][None, :] - both)
    linked &= component[left][:, None] != component[right][None, :]
    x, y = np.nonzero(linked)
    return left[x], right[y]


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, i, j), each cell the members of blocks i and j: links (a, b) that join components, as few as do."""

    def joins(rows: list) -> list[tuple[int, int]]:
        node, block, component = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
        if (component == component[0]).all():
            return []
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root.setdefault(up, up)
            return x

        found = []
        for x, y in zip(*(z.tolist() for z in _linked_pairs([np.frombuffer(r[6], "<u8") for r in rows], block, component)), strict=True):
            p, q = find(int(component[x])), find(int(component[y]))
            if p != q:
                root[p] = q
                found.append((int(min(node[x], node[y])), int(max(node[x], node[y]))))
        return found

    def out(found: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    held: list = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:3] != held[0][:3]:
                if found := joins(held):
                    yield out(found)
                held = []
            held.append(row)
    if held and (found := joins(held)):
        yield out(found)


def _links_between(met: DataFrame, components: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of nodes that share a bucket but no component: at least those that join what the bucket's links join."""
    placed = met.join(components.hint("merge"), "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    parts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"), F.min("node").alias("first"))
    blocks_of = lambda members, shingles: F.greatest(F.ceil(members / BLOCK_MEMBERS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    lead = lambda c: F.min_by(c, "first")
    apart = parts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("parts"), lead("component").alias("lead"), blocks_of(lead("members"), lead("shingles")).alias("in_lead"), blocks_of(F.sum("members") - lead("members"), F.sum("shingles") - lead("shingles")).alias("outside")
    )
    rows = placed.join(apart.filter("parts > 1").hint("merge"), "bucket")
    # blocks of members outside the leader's component come first; they meet all blocks, those inside only them
    own = F.when(F.col("component") != F.col("lead"), F.pmod(F.xxhash64("node"), F.col("outside"))).otherwise(F.col("outside") + F.pmod(F.xxhash64("node"), F.col("in_lead"))).cast("int")
    last = F.when(F.col("component") != F.col("lead"), F.col("outside") + F.col("in_lead")).otherwise(F.col("outside")) - 1
    rows = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "component")
    rows = rows.join(sets.select(F.col("id").alias("node"), "members").hint("merge"), "node").select("bucket", "i", "j", "node", "block", "component", "members")
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_joining, "a bigint, b bigint").distinct()


def _beside(pairs: DataFrame, rows: DataFrame, *values: str) -> DataFrame:
    """Pairs (a, b, level) with both sides' ``values`` of ``rows`` (id, ...). What a leader brings is copied 2^level times, so that its pairs spread."""
    copies = F.pow(F.lit(2), "level").cast("int")
    side = lambda x: rows.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in values])
    firsts = side("a").join(pairs.select("a", "level").distinct().hint("merge"), "a").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    seconds = pairs.withColumn("copy", F.pmod(F.xxhash64("b"), copies).cast("int")).join(side("b").hint("merge"), "b")
    return seconds.join(firsts.hint("merge"), ["a", "level", "copy"])


def _level(size: Column) -> Column:
    """So many doublings that 2^level copies serve ``size`` pairs."""
    return F.greatest(F.ceil(F.log2(size / PAIRS_PER_COPY)), F.lit(0)).cast("int")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    rows = materialised(identified(docs).mapInArrow(_sketched, "doc_id bigint, n_shingles bigint, class binary, sketch binary"))
    taking_part = rows.filter("doc_id is not null and n_shingles > 0")
    classes = materialised(taking_part.groupBy("class").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    key = lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * 2 * ROWS + 1, F.lit(2 * ROWS)))
    members = classes.select("node", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), key)).alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = materialised(members.join(buckets.hint("merge"), "bucket"))

    # rows of one doc_id with different texts are several classes of one node
    sketches = classes.groupBy(F.col("node").alias("id")).agg(F.first("sketch").alias("sketch"), F.first("n").alias("n"))
    near = met.filter("node != leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.max(_level(F.col("size"))).alias("level"))
    plausible = _beside(near, sketches, "n", "sketch").select("a", "b", "level", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_plausible, "a bigint, b bigint, level int")

    texts = identified(docs).join(met.select(F.col("node").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").select("doc_id", "text_key", "text")
    sets = materialised(texts.mapInArrow(_full_sets, "id bigint, members binary"))
    confirmed = _beside(materialised(plausible), sets, "members").select("a", "b", "members_a", "members_b").mapInArrow(_confirmed, "a bigint, b bigint")
    links = materialised(confirmed)
    components = connected_components(links)
    more = materialised(_links_between(met, components, sets))
    if not more.isEmpty():
        components = connected_components(links.unionByName(more))

    of_class = classes.select("class", "node").join(components.hint("merge"), "node", "left").select("class", F.coalesce("component", "node").alias("component"))
    # rows of one doc_id are one document: the least component of their sets
    placed_rows = rows.drop("sketch").join(of_class.hint("merge"), "class", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return placed_rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.reached) AS component_id, d.doc_id = min(r.reached) AS kept FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id, n.n
"""

QUERIES = {"op7_minhash_dedup": op7_minhash_dedup}
ORACLES = {"op7_minhash_dedup": ORACLE}
