"""Operator 9, exact dedup: a log-structured merge index of text digests, in DataFrame operations only.

*Memtables and runs.* Every input split is one memtable: its digests are sorted and flushed as one
sorted run (Parquet with min/max statistics and a Bloom filter on the digest).
*Compaction.* All runs are merged by digest into one level, cut by ranges of the digest and sorted, with
filters of its own; of each digest it keeps the preferred identifier and the number of rows.
*Hits.* The digests that occur more than once make a blocked Bloom filter (16 bits a digest). The texts are
read again, and only those whose digest passes the filter move. They are compared byte by byte with the
text that stays. Where bytes differ under one digest, the rows of that digest are grouped again by the
text itself, so a weak digest costs time, never correctness.

The filter is broadcast up to ``FILTER_BLOCKS`` blocks of 4 kB; an index with more repeated digests is
joined by digest instead. Digests with more than a ``PARTS``-th of all rows, fewer than ``PARTS`` in number,
are placed by broadcast, and their rows meet copies of the staying text by salts.

Defined results: a null text counts as empty; two empty texts are copies; texts that differ only in
ASCII white space are copies; a null doc_id ranks after all others; repeated rows each get a row in
the result, and those carrying the staying doc_id all count as kept; very long texts are read whole;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import documents, materialised, scratch_root, text_of

#: Blocks of the filter that are broadcast: 16 MB, for 8 million repeated digests.
FILTER_BLOCKS = 4096
#: Bits of a block, and how many of them a digest sets.
BLOCK_BITS, BITS_SET = 32768, 3
#: A digest with more than one of so many parts of all rows is hot, and is dealt in such parts.
PARTS = 1000


def normalised(column: str = "text") -> Column:
    """The text without white space of ASCII."""
    return F.regexp_replace(text_of(column), r"[\x20\x09-\x0D]+", "")


def sha256_digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _entries(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    keyed = docs.select("doc_id", normalised().alias("norm"), F.length(text_of()).alias("n_code_points"))
    return keyed.withColumn("digest", digest(F.col("norm"))).withColumn("text_sha256", F.sha2("norm", 256))


def _written(sorted_rows: DataFrame, path: str, keys_per_file: int) -> None:
    writer = sorted_rows.write.mode("append").option("compression", "zstd").option("parquet.bloom.filter.enabled#digest", "true")
    writer.option("parquet.bloom.filter.expected.ndv#digest", str(keys_per_file)).parquet(path)


def flush_runs(entries: DataFrame, path: str, keys_per_run: int = 50_000) -> None:
    """Append one sorted run per input split to the index at ``path``."""
    _written(entries.select("digest", "doc_id", "n_code_points", "text_sha256").sortWithinPartitions("digest"), path, keys_per_run)


def _preferred() -> Column:
    """The longest original, then the smallest doc_id."""
    return F.struct((-F.col("n_code_points")).alias("minus_length"), F.col("doc_id").isNull().alias("no_id"), "doc_id")


def merged(runs: DataFrame) -> DataFrame:
    """Of each digest the row that stays and the number of rows."""
    return runs.groupBy("digest").agg(F.min(_preferred()).alias("best"), F.count(F.lit(1)).alias("group_size")).select("digest", F.col("best.doc_id").alias("keep_id"), "group_size")


def compact(runs: DataFrame, path: str, keys_per_file: int = 200_000) -> None:
    """Merge all runs into a level at ``path``: ranges of digests, each sorted, with filters."""
    _written(merged(runs).repartitionByRange("digest").sortWithinPartitions("digest"), path, keys_per_file)


def probe(spark: SparkSession, path: str, digests: list[str]) -> DataFrame:
    """Rows of runs or of a level for a few given digests; statistics and Bloom filters skip the files without them."""
    return spark.read.parquet(path).filter(F.col("digest").isin(digests))


def _bits() -> Column:
    """The places in its block that a digest sets."""
    return F.array(*[F.pmod(F.xxhash64("digest", F.lit(i)), F.lit(BLOCK_BITS)) for i in range(1, BITS_SET + 1)])


def _block(n_blocks: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n_blocks))


def digest_filter(digests: DataFrame, n_blocks: int) -> DataFrame:
    """A blocked Bloom filter as a table: (block, bits of 4 kB)."""
    return digests.select(_block(n_blocks).alias("block"), F.explode(_bits()).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def passing(rows: DataFrame, kept: DataFrame, n_blocks: int) -> DataFrame:
    """Rows whose digest may be in the filter. ``kept`` has ``n_blocks`` rows at most and is broadcast."""
    found = rows.withColumn("block", _block(n_blocks)).join(F.broadcast(kept), "block")
    is_set = lambda bit: F.conv(F.hex(F.substring(F.col("bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0
    return found.filter(F.forall(_bits(), is_set)).drop("block", "bits")


def _differing(hits: DataFrame, hot: DataFrame) -> DataFrame:
    """Digests of hits whose bytes differ from the staying row's. ``hot`` has PARTS rows at most; such digests are split by salts, and the staying text goes to each."""
    parts = F.broadcast(hot.select("digest", "parts"))
    salt = F.pmod(F.xxhash64("doc_id", "n_code_points", F.spark_partition_id()), F.coalesce("parts", F.lit(1).cast("long")))
    members = hits.join(parts, "digest", "left").select("digest", "norm", salt.alias("salt"))
    stays = hits.groupBy("digest").agg(F.min_by("norm", _preferred()).alias("keep_norm"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stays = stays.join(parts, "digest", "left").select("digest", "keep_norm", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)).alias("salt"))
    return members.join(stays.hint("merge"), ["digest", "salt"]).filter(F.col("norm") != F.col("keep_norm")).select("digest").distinct()


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    entries, at_runs, at_level = _entries(docs, digest), scratch_root(spark), scratch_root(spark)
    flush_runs(entries, at_runs)
    runs = spark.read.parquet(at_runs)
    compact(runs, at_level)
    level = spark.read.parquet(at_level)
    repeated = level.filter("group_size > 1")
    total, n_repeated = level.agg(F.coalesce(F.sum("group_size"), F.lit(0)), F.count_if(F.col("group_size") > 1)).first()
    hot = repeated.filter(F.col("group_size") * PARTS > total).withColumn("parts", F.ceil(F.col("group_size") * PARTS / F.lit(total)).cast("long"))

    n_blocks = -(-16 * n_repeated // BLOCK_BITS) or 1
    if n_blocks <= FILTER_BLOCKS:
        hits = passing(entries, materialised(digest_filter(repeated, n_blocks)), n_blocks)
    else:
        hits = entries.join(repeated.select("digest").hint("merge"), "digest")
    hits = materialised(hits)
    differing = materialised(_differing(hits, hot))

    known = runs.join(F.broadcast(hot.drop("parts")), "digest").select("doc_id", "keep_id", "group_size", "text_sha256", "digest")
    others = runs.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(repeated.hint("merge"), "digest", "left")
    others = others.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256", "digest")
    placed = known.unionByName(others)
    if not differing.isEmpty():
        clashing = hits.join(differing.hint("merge"), "digest", "left_semi").withColumn("digest", F.struct("digest", "norm"))
        regrouped = clashing.join(merged(clashing).hint("merge"), "digest").select("doc_id", "keep_id", "group_size", "text_sha256")
        placed = placed.join(differing.hint("merge"), "digest", "left_anti").drop("digest").unionByName(regrouped)
    return placed.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLES = {"op9_exact_dedup": ORACLE}
