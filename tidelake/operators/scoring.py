"""Scoring with a promoted model: what the artifacts say, checked features, calibrated decisions, contributions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.market import interpolated


@dataclass(frozen=True)
class Scorer:
    """A probability of the feature columns, its calibrator's knots, and the threshold from which quotes are withheld."""

    name: str
    columns: tuple[str, ...]
    probability: Callable[[list[Column]], Column]
    knots: tuple[list[float], list[float]] | None
    threshold: float | None


def load_scorer(probability: Callable[[list[Column]], Column], calibrator: dict, report: dict, policy: dict | None = None) -> Scorer:
    """Feature columns from the calibrator, else the report; the threshold from calibrator, policy or report, in this order."""
    columns = calibrator.get("feature_columns") or report.get("feature_columns")
    if not columns:
        raise ValueError("neither calibrator nor report names feature columns")
    thresholds = (x.get("decision_threshold") for x in (calibrator, policy or {}, report))
    threshold = next((t for t in thresholds if t is not None), None)
    knots = (calibrator["x_thresholds"], calibrator["y_thresholds"]) if calibrator.get("enabled", True) and calibrator.get("x_thresholds") else None
    return Scorer(report.get("model_name", "model"), tuple(columns), probability, knots, threshold)


def scored(rows: DataFrame, scorer: Scorer, fill_missing: float | None = None) -> DataFrame:
    """raw_score, calibrated_score and action. A column that rows lack is an error, unless it is filled."""
    missing = [c for c in scorer.columns if c not in rows.columns]
    if missing and fill_missing is None:
        raise ValueError(f"missing model features: {', '.join(missing[:5])}" + (f", +{len(missing) - 5} more" if len(missing) > 5 else ""))
    features = [F.col(c).cast("double") if c in rows.columns else F.lit(float(fill_missing)) for c in scorer.columns]
    out = rows.withColumn("raw_score", F.least(F.greatest(scorer.probability(features), F.lit(0.0)), F.lit(1.0)))
    out = out.withColumn("calibrated_score", interpolated(F.col("raw_score"), *scorer.knots) if scorer.knots else F.col("raw_score"))
    withheld = F.col("calibrated_score") >= F.lit(scorer.threshold) if scorer.threshold is not None else F.lit(False)
    return out.withColumn("action", F.when(withheld, "withhold_quote").otherwise("quote"))


def score_gold(rows: DataFrame, scorer: Scorer, limit: int = 0, latest: bool = True, tie: str = "tid") -> DataFrame:
    """The newest ``limit`` rows (or the oldest, or all) with their scores and the three largest features."""
    if limit:
        rows = rows.orderBy(F.desc("ts_ms"), F.desc(tie)).limit(limit) if latest else rows.orderBy("ts_ms", tie).limit(limit)
    return scored(rows, scorer).withColumn("top_features", contributions([F.col(c) for c in scorer.columns], list(scorer.columns), [1.0] * len(scorer.columns)))


def contributions(values: list[Column], names: list[str], importances: list[float], k: int = 3) -> Column:
    """The k largest products of value and global importance, by absolute value; of equal ones the first named."""
    items = F.array(*[F.struct((-F.abs(v.cast("double") * w)).alias("order"), F.lit(i).alias("i"), F.lit(n).alias("name"), (v.cast("double") * w).alias("share")) for i, (v, n, w) in enumerate(zip(values, names, importances, strict=True))])
    return F.transform(F.slice(F.array_sort(items), 1, k), lambda x: F.struct(x["name"].alias("name"), x["share"].alias("share")))


def array_contributions(values: str, importance: Callable[[Column], Column], k: int = 3) -> Column:
    """As ``contributions``, of an array of any length: ``importance`` of a component by its number from 0, names f1, f2, ..."""
    share = lambda x, i: x.cast("double") * importance(i)
    items = F.transform(values, lambda x, i: F.struct((-F.abs(share(x, i))).alias("order"), i.alias("i"), share(x, i).alias("share")))
    return F.transform(F.slice(F.array_sort(items), 1, k), lambda x: F.struct(F.concat(F.lit("f"), x["i"] + 1).alias("name"), x["share"].alias("share")))


def optional_bool(column: str) -> Column:
    """True for 1, true, yes; false for any other word; null stays null."""
    word = F.lower(F.trim(F.col(column).cast("string")))
    return F.when(F.col(column).isNull(), F.lit(None).cast("boolean")).otherwise(word.isin("1", "true", "yes"))


def safe_number(column: str) -> Column:
    """Null for what JSON has no number for."""
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), F.col(column))
