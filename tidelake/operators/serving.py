"""What an application asks of the lake and of a promoted model: snapshots, refreshed decisions, artifacts, health."""

from __future__ import annotations

import json
import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions import market
from tidelake.operators import lake, policy, scoring, tables

#: Metrics of a report that a model's health shows.
# The names of a report's metrics that health shows.
HEALTH_METRICS = ("n_rows", "pr_auc", "brier", "ece", "markout_lift_bps", "quote_rate", "leakage_safe")


def newest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row of each key; an aggregate, so that hot keys combine before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def snapshots(book: DataFrame, contexts: DataFrame) -> DataFrame:
    """Of each coin the newest top of book with its features, and the newest context, null where a coin has none."""
    top = lake.silver_book(newest(book, "coin", "ts_ms", "tie"))
    context = newest(contexts.withColumn("basis_bps", market.basis_bps()), "coin", "ts_ms", "tie").drop("ts_ms", "tie")
    return top.join(context.hint("merge"), "coin", "left").withColumn("symbol", F.concat(F.col("coin").cast("string"), F.lit("-PERP")))


def recent_candles(candles: DataFrame, minutes: int) -> DataFrame:
    """Of each coin the candles of the last minutes before its newest one."""
    if minutes <= 0:
        raise ValueError("minutes must be positive")
    last = candles.groupBy("coin").agg(F.max("ts_ms").alias("last_ms"))
    return candles.join(last.hint("merge"), "coin").filter(F.col("ts_ms") >= F.col("last_ms") - minutes * 60_000).drop("last_ms")


def write_artifact(spark: SparkSession, path: str, artifact: dict) -> None:
    """One JSON document at ``path``."""
    spark.createDataFrame([(json.dumps(artifact),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_artifact(spark: SparkSession, path: str) -> dict:
    try:
        return json.loads(spark.read.text(path, wholetext=True).first()["value"])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"{path} is not there") from error


def write_calibrator(spark: SparkSession, path: str, knots: tuple[list[float], list[float]] | None, **metadata) -> None:
    """An isotonic calibrator's knots and what else a scorer reads from it; without knots it is disabled."""
    shape = {} if knots is None else {"x_thresholds": [float(x) for x in knots[0]], "y_thresholds": [float(y) for y in knots[1]]}
    write_artifact(spark, path, {"method": "isotonic", "enabled": knots is not None} | metadata | shape)


def _log(spark: SparkSession, root: str, run: int, trigger: str, status: str, count: int, message: str) -> None:
    row = spark.createDataFrame([(run, trigger, status, count, message)], "run bigint, trigger string, status string, refreshed bigint, message string")
    row.write.mode("append").parquet(f"{root}/refresh_log")


def refresh_decisions(spark: SparkSession, gold: str, probability, artifacts: dict[str, str], root: str, run: int, limit: int = 100, trigger: str = "manual") -> None:
    """Score the newest ``limit`` rows of the newest partition below ``gold`` and add them to the decisions below ``root``.

    ``artifacts`` says where calibrator and report are. Each run is logged as running, then as succeeded or failed. Its
    decisions count once all are written; of a decision made again, the latest run's counts.
    """
    _log(spark, root, run, trigger, "running", 0, "")
    try:
        scorer = scoring.load_scorer(probability, read_artifact(spark, artifacts["calibrator"]), read_artifact(spark, artifacts["report"]))
        rows = scoring.score_gold(lake.newest_partition(spark, gold).withColumn("maker_side", market.maker_side()), scorer, limit)
    except (FileNotFoundError, ValueError) as unusable:
        _log(spark, root, run, trigger, "failed", 0, str(unusable))
        return
    decided = rows.withColumns({"decision_id": F.concat_ws(":", "coin", "ts_ms", "tid"), "severity": policy.fill_severity("action", "calibrated_score"), "model_name": F.lit(scorer.name), "source_path": F.lit(gold)})
    tables.persist_run({"decisions": decided}, root, str(run))
    refreshed = spark.read.parquet(f"{root}/decisions/run={run}").count()
    _log(spark, root, run, trigger, "succeeded", refreshed, "")


def current_decisions(spark: SparkSession, root: str) -> DataFrame:
    """Each decision as the latest finished run left it."""
    rows = tables.read_run_table(spark, root, "decisions").withColumn("run", F.col("run_id").cast("long")).drop("run_id")
    return newest(rows, "decision_id", "run")


def refresh_runs(spark: SparkSession, root: str) -> DataFrame:
    """Each run with its last state."""
    log = spark.read.parquet(f"{root}/refresh_log")
    return newest(log.withColumn("ended", F.col("status") != "running"), "run", "ended").drop("ended")


def model_health(spark: SparkSession, probability, artifacts: dict[str, str]) -> dict:
    """Whether a promoted model can score, which artifacts it lacks, its report's metrics, its score of a row of zeros and how long that took."""
    found, missing = {}, []
    for name, path in artifacts.items():
        try:
            found[name] = read_artifact(spark, path)
        except FileNotFoundError:
            missing.append(name)
    if missing:
        return {"available": False, "message": "the model can't score without all of its files", "missing": missing}
    try:
        scorer = scoring.load_scorer(probability, found["calibrator"], found["report"])
    except ValueError as unusable:
        return {"available": False, "message": str(unusable), "missing": []}
    began = time.perf_counter()
    smoke = scoring.scored(spark.range(1), scorer, fill_missing=0.0).first()
    latency_ms = (time.perf_counter() - began) * 1000
    metrics = {name: found["report"][name] for name in HEALTH_METRICS if name in found["report"]}
    return {"available": True, "model_name": scorer.name, "threshold": scorer.threshold, "columns": list(scorer.columns), "metrics": metrics, "smoke_score": smoke["calibrated_score"], "smoke_action": smoke["action"], "latency_ms": latency_ms}


def payload_hash(*columns: str) -> Column:
    """An aggregate: one hash of a group's rows, in whatever order they come. Rows are hashed one by one and summed in
    eight pieces, so no group is gathered; a row given twice counts twice."""
    each = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    sums = [F.sum(F.conv(F.substring(each, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(8)]
    return F.sha2(F.concat_ws(",", *sums), 256)


def scenario_manifests(events: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """Of each scenario its family, how many events it has, whether any is unsafe, and hashes of events and labels."""
    about = events.groupBy("scenario_id").agg(F.min("family").alias("family"), F.count(F.lit(1)).alias("event_count"), payload_hash(*columns).alias("event_hash"))
    judged = labels.groupBy("scenario_id").agg(F.bool_or("unsafe").alias("unsafe"), payload_hash("event_id", "unsafe").alias("label_hash"))
    return about.join(judged.hint("merge"), "scenario_id")
