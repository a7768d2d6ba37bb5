"""Operator 9 over time: a log-structured merge index of text digests that takes batch after batch, in DataFrame operations only.

A batch is a memtable: its distinct texts, each with its preferred identifier and number of rows, are flushed as one
run, sorted by digest, with a blocked Bloom filter beside it. Before that the batch's digests are put to the filters
of all older runs; those that pass meet the run by digest, and the text itself decides (byte verification), so a
false alarm of a filter or a weak digest costs time, never correctness. When a level holds ``fan_out`` runs they are
merged into one run of the next level, which keeps the smallest preferred identifier and the sum of the rows. A run's
place is listed in small numbered state files; a batch that fails leaves no trace in them.

What a batch's rows are told is true at that time: a later batch may bring a longer original. ``groups`` tells how
things stand.

Defined results: as for exact_dedup; within a batch repeated rows each get a row.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import exact_dedup
from tidelake.llm.common import materialised, text_of

ENTRY = "digest string, norm string, minus_length int, no_id boolean, doc_id bigint, n bigint"


def _entries(docs: DataFrame) -> DataFrame:
    norm = exact_dedup.normalised()
    rows = docs.select(F.col("doc_id").cast("long"), norm.alias("norm"), (-F.length(text_of())).alias("minus_length"))
    return rows.select(F.sha2("norm", 256).alias("digest"), "norm", "minus_length", F.col("doc_id").isNull().alias("no_id"), "doc_id", F.lit(1).cast("long").alias("n"))


def _merged(entries: DataFrame) -> DataFrame:
    """One entry for each text."""
    best = F.min(F.struct("minus_length", "no_id", "doc_id")).alias("best")
    return entries.groupBy("digest", "norm").agg(best, F.sum("n").alias("n")).select("digest", "norm", "best.*", "n")


class DigestIndex:
    """The index below ``root``. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, fan_out: int = 4):
        self.spark, self.root, self.fan_out = spark, root.rstrip("/"), fan_out

    def _state(self) -> dict:
        """The newest state: how many were written, runs by level (oldest first)."""
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/state")
        written = sorted(s.getPath().getName() for s in fs.listStatus(at) if fs.exists(s.getPath().suffix("/_SUCCESS"))) if fs.exists(at) else []
        return json.loads(self.spark.read.text(f"{self.root}/state/{written[-1]}").first()["value"]) if written else {"n": 0, "made": 0, "levels": []}

    def _put(self, state: dict) -> None:
        state["n"] += 1
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.root}/state/{state['n']:012d}")

    def runs(self) -> list[dict]:
        """name, level, keys and filter blocks of every run, newest first."""
        levels = self._state()["levels"]
        return [{**run, "level": k} for k, level in enumerate(levels) for run in reversed(level)]

    def _flush(self, entries: DataFrame, name: str) -> dict:
        """A run: sorted ranges of digests, and its filter."""
        path = f"{self.root}/runs/{name}"
        writer = entries.repartitionByRange("digest").sortWithinPartitions("digest").write.mode("overwrite").option("compression", "zstd")
        writer.option("parquet.bloom.filter.enabled#digest", "true").parquet(path)
        run = self.spark.read.schema(ENTRY).parquet(path)
        keys = run.count()
        blocks = -(-16 * keys // exact_dedup.BLOCK_BITS) or 1
        exact_dedup.digest_filter(run, blocks).write.mode("overwrite").parquet(f"{self.root}/filters/{name}")
        return {"name": name, "keys": keys, "blocks": blocks}

    def _read(self, run: dict) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(f"{self.root}/runs/{run['name']}")

    def _passing(self, digests: DataFrame, run: dict) -> DataFrame:
        """Digests that a run's filter lets through; all of them, to meet the run itself, where the filter is too large to send around."""
        kept = self.spark.read.schema("block bigint, bits binary").parquet(f"{self.root}/filters/{run['name']}")
        return exact_dedup.passing(digests, kept, run["blocks"]) if run["blocks"] <= exact_dedup.FILTER_BLOCKS else digests

    def hits(self, entries: DataFrame) -> DataFrame:
        """Entries of older runs whose text one of ``entries`` has, by its very bytes."""
        found = self.spark.createDataFrame([], ENTRY)
        asked = entries.select("digest", "norm")
        for run in self.runs():  # a few for each level, whose number grows with the logarithm of the batches
            few = self._passing(asked, run)
            found = found.unionByName(self._read(run).join(few.hint("merge"), ["digest", "norm"], "left_semi"))
        return found

    def add(self, docs: DataFrame) -> DataFrame:
        """Takes a batch in. One row per document: doc_id, keep_id, group_size (of all batches so far), kept, text_sha256."""
        rows = materialised(_entries(docs))
        batch = materialised(_merged(rows))
        now = materialised(_merged(batch.unionByName(self.hits(batch))).select("digest", "norm", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size")))
        state = self._state()
        levels, made = state["levels"] or [[]], state["made"]
        levels[0].append(self._flush(batch, f"{made:08d}"))
        made += 1
        level = 0
        while len(levels[level]) >= self.fan_out:
            whole = [self._read(run) for run in levels[level]]
            merged = whole[0]
            for other in whole[1:]:
                merged = merged.unionByName(other)
            if level + 1 == len(levels):
                levels.append([])
            levels[level + 1].append(self._flush(_merged(merged), f"{made:08d}"))
            levels[level], made, level = [], made + 1, level + 1
        self._put({"n": state["n"], "made": made, "levels": levels})
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
        return rows.join(now.hint("merge"), ["digest", "norm"]).select("doc_id", "keep_id", "group_size", kept, F.col("digest").alias("text_sha256"))

    def groups(self) -> DataFrame:
        """text_sha256, keep_id and group_size of every text that the index holds."""
        entries = self.spark.createDataFrame([], ENTRY)
        for run in self.runs():
            entries = entries.unionByName(self._read(run))
        return _merged(entries).select(F.col("digest").alias("text_sha256"), F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))

    def lookup(self, docs: DataFrame) -> DataFrame:
        """Of documents that are not taken in: those whose text the index holds already (doc_id, keep_id, group_size)."""
        rows = _entries(docs)
        found = _merged(self.hits(_merged(rows))).select("digest", "norm", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
        return rows.join(found.hint("merge"), ["digest", "norm"]).select("doc_id", "keep_id", "group_size")
