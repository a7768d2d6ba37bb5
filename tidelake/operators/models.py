"""Boosted trees and isotonic calibration, out of fold, on pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.functions.market import interpolated
from tidelake.operators import ordered, stats
from tidelake.session import checkpointed


def _known(features: list[str]):
    return reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in features])


def _assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(rows)


def fit_boosted(rows: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 3, rate: float = 0.08, seed: int = 42):
    """A boosted-tree model of a boolean label, trained on the rows that have every feature."""
    rows = rows.filter(_known(features))
    return GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed).fit(_assembled(rows, features).withColumn("_y", F.col(label).cast("double")))


def score(model, rows: DataFrame, features: list[str], out: str = "p") -> DataFrame:
    """Every row with its probability; null where a feature is missing."""
    scored = model.transform(_assembled(rows, features)).withColumn(out, F.when(_known(features), vector_to_array("probability")[1]))
    return scored.drop("_x", "rawPrediction", "probability", "prediction")


_BLOCKS = "part int, lo double, hi double, n bigint, total double"
#: What a row's value takes, about.
_VALUE_BYTES = 16
#: Parts whose blocks meet in one at each level of the tree.
_FAN = 16


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pool adjacent violators over blocks that come sorted by part and lo: a block whose mean isn't above its neighbour's joins it."""
    part, lo, hi, n, total = None, [], [], [], []

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([part] * len(lo), pa.int32()), pa.array(lo, pa.float64()), pa.array(hi, pa.float64()), pa.array(n, pa.int64()), pa.array(total, pa.float64())], ["part", "lo", "hi", "n", "total"])

    for batch in batches:
        for of, a, b, count, positive in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if of != part:
                if lo:
                    yield out()
                part, lo, hi, n, total = of, [], [], [], []
            while lo and total[-1] * count >= positive * n[-1]:
                a, count, positive = lo.pop(), count + n.pop(), positive + total.pop()
                hi.pop()
            lo.append(a)
            hi.append(b)
            n.append(count)
            total.append(positive)
    if lo:
        yield out()


def isotonic_blocks(rows: DataFrame, p: str, label: str, parts: int | None = None) -> DataFrame:
    """The isotonic fit of a boolean label on a score, as blocks: lo, hi, n and total (of positives), by lo.

    Scores are counted first. Range parts of them are pooled on their own, then the blocks of neighbouring parts
    together, up a tree: pooled parts pool to what the whole does. Blocks are few (about the cube root of the rows),
    unless rates rise at every score.
    """
    counts = rows.filter(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("lo")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("total"))
    parts = parts or ordered.parts_for(counts)
    cut = counts.repartitionByRange(parts, "lo").select(F.spark_partition_id().alias("part"), "lo", F.col("lo").alias("hi"), "n", "total").sortWithinPartitions("part", "lo")
    blocks = cut.mapInArrow(_pooled, _BLOCKS)
    while parts > 1:
        blocks = checkpointed(blocks)  # parts are cut once
        parts = -(-parts // _FAN)
        met = blocks.withColumn("part", F.expr(f"cast(part div {_FAN} as int)")).repartition(parts, "part").sortWithinPartitions("part", "lo")
        blocks = met.mapInArrow(_pooled, _BLOCKS)
    return blocks.select("lo", "hi", "n", "total")


def fit_isotonic(rows: DataFrame, p: str, label: str, parts: int | None = None) -> tuple[list[float], list[float]] | None:
    """Knots of an isotonic calibrator, both ends of each block; none with a single class."""
    blocks = sorted(isotonic_blocks(rows, p, label, parts).collect(), key=lambda b: b["lo"])
    positive, n = sum(b["total"] for b in blocks), sum(b["n"] for b in blocks)
    if positive in (0, n):
        return None
    knots = [(x, b["total"] / b["n"]) for b in blocks for x in ([b["lo"]] if b["lo"] == b["hi"] else [b["lo"], b["hi"]])]
    return [x for x, _ in knots], [y for _, y in knots]


def out_of_fold(rows: DataFrame, features: list[str], label: str, folds: int, purge_ms: int, embargo_ms: int, calibration: float = 0.2, **settings) -> DataFrame:
    """Scores of every row by a model that has not seen its fold, nor rows close to it in time.

    A fold's model trains on the rows outside [start - purge, end + embargo]; the latest fifth of these only
    calibrates it. ``rows`` has ts_ms and id. One model per fold: the loop is over folds, not over data.

    Rows and their folds are written once, as every tree reads them anew; parts are cut by how many rows there are.
    """
    rows = checkpointed(rows)
    parts = -(-rows.count() * len(rows.columns) * _VALUE_BYTES // ordered.PART_BYTES) or 1
    folded = checkpointed(stats.with_folds(rows, folds, ["ts_ms", "id"], parts))
    bounds = folded.groupBy("fold").agg(F.min("ts_ms").alias("start"), F.max("ts_ms").alias("end")).orderBy("fold").collect()
    found = []
    for b in bounds:
        train = folded.filter((F.col("ts_ms") < b["start"] - purge_ms) | (F.col("ts_ms") > b["end"] + embargo_ms))
        cut = ordered.percentiles(train, "ts_ms", {"cut": 1 - calibration}, parts=parts).first()["cut"]
        model = fit_boosted(train.filter(F.col("ts_ms") <= cut), features, label, **settings)
        knots = fit_isotonic(score(model, train.filter(F.col("ts_ms") > cut), features), "p", label, parts)
        scored = score(model, folded.filter(F.col("fold") == b["fold"]), features, "raw")
        found.append(scored.withColumn("p", interpolated(F.col("raw"), *knots) if knots else F.col("raw")))
    return reduce(DataFrame.unionByName, found)


def family_split(rows: DataFrame, held_out: list[str], family: str = "scenario", share: float = 0.25, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): whole families held out, or, where none is named, a share of every family drawn by hash."""
    if held_out:
        return rows.filter(~F.col(family).isin(held_out)), rows.filter(F.col(family).isin(held_out))
    drawn = F.pmod(F.xxhash64(F.lit(seed), *rows.columns), F.lit(10_000)) < int(share * 10_000)
    return rows.filter(~drawn), rows.filter(drawn)


def risk_head(train: DataFrame, test: DataFrame, features: list[str], label: str, trees: int = 200, depth: int = 3, rate: float = 0.08):
    """A boosted risk head and its report on ``test``: size, ranking and calibration, and the features' importances."""
    model = fit_boosted(train, features, label, trees, depth, rate)
    judged = score(model, test, features).withColumn("y", F.col(label).cast("boolean")).filter("p is not null")
    report = judged.agg(F.count(F.lit(1)).alias("n"), stats.brier().alias("brier"), stats.f1(0.5).alias("f1")).first().asDict()
    report |= {"pr_auc": stats.pr_auc_optimistic(judged).first()[0], "auroc": stats.auroc(judged).first()[0], "importances": dict(zip(features, model.featureImportances.toArray().tolist(), strict=True))}
    return model, report
