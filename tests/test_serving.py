"""Refreshed decisions, artifacts, health and hashes."""

import pytest
from pyspark.sql import functions as F

from tidelake.operators import lake, serving


def half(x):
    return 0.5 + 0 * x[0]


def test_refresh_runs_and_health(spark, tmp_path):
    root = str(tmp_path)
    fills = spark.createDataFrame([("sol", 5, 1, "B"), ("sol", 86_400_000, 2, "A"), ("sol", 86_400_001, 3, "B")], "coin string, ts_ms long, tid long, side string").withColumn("crossed", F.lit(False))
    gold = lake.write_table(fills, root, "training_rows")
    at = {"calibrator": f"{root}/c", "report": f"{root}/r"}
    assert serving.model_health(spark, half, at)["missing"] == ["calibrator", "report"]
    serving.refresh_decisions(spark, gold, half, at, root, 1)
    serving.write_calibrator(spark, at["calibrator"], None, decision_threshold=0.4)
    serving.write_artifact(spark, at["report"], {"brier": 0.1, "other": 1})
    assert "feature columns" in serving.model_health(spark, half, at)["message"]
    serving.write_artifact(spark, at["report"], {"brier": 0.1, "other": 1, "feature_columns": ["maker_side"]})
    serving.refresh_decisions(spark, gold, half, at, root, 2, limit=1)
    serving.write_calibrator(spark, at["calibrator"], ([0.0, 1.0], [0.0, 0.2]), decision_threshold=0.4)
    serving.refresh_decisions(spark, gold, half, at, root, 3, limit=10)
    runs = {r["run"]: (r["status"], r["refreshed"]) for r in serving.refresh_runs(spark, root).collect()}
    assert runs == {1: ("failed", 0), 2: ("succeeded", 1), 3: ("succeeded", 2)}
    got = {r["tid"]: (r["run"], r["action"]) for r in serving.current_decisions(spark, root).collect()}
    assert got == {2: (3, "quote"), 3: (3, "quote")}
    health = serving.model_health(spark, half, at)
    assert health["available"] and health["metrics"] == {"brier": 0.1} and health["smoke_score"] == pytest.approx(0.1)


def test_payload_hash_counts_rows_not_their_order(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "i long, s string")
    one = rows.agg(serving.payload_hash("i", "s")).first()[0]
    assert rows.orderBy(F.desc("i")).repartition(3).agg(serving.payload_hash("i", "s")).first()[0] == one
    assert rows.distinct().agg(serving.payload_hash("i", "s")).first()[0] != one


def test_snapshots_without_context(spark):
    book = spark.createDataFrame([("a", 1, 10.0, 12.0, 1.0, 1.0, 1), ("a", 2, 20.0, 22.0, 1.0, 1.0, 2)], "coin string, ts_ms long, bid_px double, ask_px double, bid_sz double, ask_sz double, tie long")
    contexts = spark.createDataFrame([("b", 1, 0.1, 1.0, 1.0, 1)], "coin string, ts_ms long, funding double, oracle_px double, mark_px double, tie long")
    got = serving.snapshots(book, contexts).collect()
    assert [(r["symbol"], r["ts_ms"], r["mid"], r["funding"]) for r in got] == [("a-PERP", 2, 21.0, None)]
    with pytest.raises(ValueError, match="positive"):
        serving.recent_candles(book, 0)
