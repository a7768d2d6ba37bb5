"""Operator 10, quality by importance resampling over hashed n-grams.

Two generative models of hashed unigrams and bigrams are counted: one over all documents (raw), one
over documents labelled good (target). A document's log weight is the sum over its n-grams of
log p_target - log p_raw. Adding Gumbel noise and keeping the top k samples k documents without
replacement in proportion to their weights. The noise comes from a hash of doc_id and seed.

k is a share of all documents, by default the share of good ones among the labelled. The k-th largest
key is found exactly by radix selection: small histograms of the key's bits, never a global sort.

The target model is fitted on at most ``MAX_LABELLED`` good documents, drawn by hash; the raw model and
all else covers every document.

Defined results: a document without words (null, empty, white space) has log weight null, and is kept
only when all others are; without good labels all weights are 0; equal keys are kept by smaller doc_id,
null last; rows alike in key and doc_id are kept or left together, left if k would be passed; very long
texts are counted whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import documents, materialised, text_of

TOKEN = r"(?U)\w+|[^\w\s]+"
FEATURES = 1 << 14
MAX_LABELLED = 50_000
#: Added to every feature's count in either model.
SMOOTHING = 1.0


def _features(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed unigrams and bigrams of a batch: (row, feature)."""
    coded = words.flatten().dictionary_encode()
    code = np.fromiter((zlib.crc32(w.encode()) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = code[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    pair = row[1:] == row[:-1]
    mixed = ((h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))) >> np.uint64(17)
    return np.concatenate([row, row[1:][pair]]), (np.concatenate([h, mixed[pair]]) % np.uint64(FEATURES)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
    for batch in batches:
        row, feature = _features(batch.column(0))
        good = batch.column(1).to_numpy(zero_copy_only=False)
        raw += np.bincount(feature, minlength=FEATURES)
        target += np.bincount(feature[good[row]], minlength=FEATURES)
    met = np.flatnonzero(raw)
    yield pa.record_batch([pa.array(met), pa.array(raw[met]), pa.array(target[met])], ["feature", "raw", "target"])


def ordered_bits(keys: np.ndarray) -> np.ndarray:
    """64 bits of each number, which compare, read without sign, as the numbers do."""
    bits = (keys + 0.0).view(np.int64)  # -0 is 0
    return np.where(bits < 0, ~bits, bits ^ np.iinfo(np.int64).min)


def _weighed(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, feature = _features(batch.column(1))
        weight = np.bincount(row, ratio[feature], len(batch))
        empty = np.bincount(row, minlength=len(batch)) == 0
        key = weight + batch.column(2).to_numpy(zero_copy_only=False)
        arrays = [batch.column(0), pa.array(weight, mask=empty), pa.array(key, mask=empty), pa.array(np.where(empty, 0, ordered_bits(key)))]
        yield pa.record_batch(arrays, ["doc_id", "log_weight", "sample_key", "key_bits"])


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p_target - log p_raw per feature; the driver gets FEATURES numbers."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    marked = docs.select("doc_id", "text").join(F.broadcast(good.withColumn("good", F.lit(True))), "doc_id", "left")  # MAX_LABELLED ids at most
    words = marked.select(F.regexp_extract_all(text_of(), F.lit(TOKEN), F.lit(0)).alias("words"), F.coalesce("good", F.lit(False)).alias("good"))
    counted = words.mapInArrow(_counted, "feature bigint, raw bigint, target bigint").groupBy("feature").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.full(FEATURES, SMOOTHING), np.full(FEATURES, SMOOTHING)
    for r in counted.collect():
        raw[r["feature"]] += r["raw"]
        target[r["feature"]] += r["target"]
    if target.sum() == FEATURES * SMOOTHING:
        return np.zeros(FEATURES)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def good_share(docs: DataFrame, labels: DataFrame) -> float:
    """Share of good ones among the labelled; 1 without labels."""
    row = labels.filter("quality is not null").agg(F.avg((F.col("quality") == 1).cast("double")).alias("share")).first()
    return 1.0 if row["share"] is None else float(row["share"])


def gumbel(seed: int) -> Column:
    """Gumbel noise, the same for a doc_id and seed wherever it is computed."""
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def _rows_above(keyed: DataFrame, k: int) -> Column:
    """The condition that holds for exactly the k rows largest by (rank_key, tie): radix selection, 16 bits at a time."""
    at_least, left = F.lit(False), k
    scope: Column = F.lit(True)
    for name in ("key_bits", "order_bits"):
        for shift in (48, 32, 16, 0):
            digit = F.shiftright(name, shift).bitwiseAND(F.lit(0xFFFF))
            counts = {r["digit"]: r["n"] for r in keyed.filter(scope).groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 65,536 rows at most
            for value in sorted(counts, reverse=True):
                if counts[value] > left:
                    break
                left -= counts[value]
            else:
                return at_least | scope
            at_least = at_least | (scope & (digit > value))
            scope = scope & (digit == value)
            if left == 0:
                return at_least
    return at_least


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 7) -> DataFrame:
    """doc_id, log_weight, sample_key and kept, the sampled documents."""
    ratio = log_ratios(docs, labels)
    words = docs.select(F.col("doc_id").cast("long"), F.regexp_extract_all(text_of(), F.lit(TOKEN), F.lit(0)).alias("words"), gumbel(seed).alias("noise"))
    scored = words.mapInArrow(lambda it: _weighed(it, ratio), "doc_id bigint, log_weight double, sample_key double, key_bits bigint")
    order = F.when(F.col("doc_id").isNull(), F.lit(0).cast("long")).otherwise(F.lit((1 << 62)) - F.col("doc_id"))
    keyed = materialised(scored.withColumn("order_bits", order))
    n = keyed.count()
    k = round(n * (good_share(docs, labels) if share is None else share))
    return keyed.select("doc_id", "log_weight", "sample_key", _rows_above(keyed, k).alias("kept"))


def op10_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op10_quality_resampling": op10_quality_resampling}
ORACLES: dict[str, str] = {}
