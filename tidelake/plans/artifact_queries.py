"""Artifacts, refreshed decisions, snapshots and manifests, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.operators import lake, scenarios, serving
from tidelake.plans import adapters as v
from tidelake.plans.model_queries import _CALIBRATED_SQL, _GOLD_SQL, _X, _Y
from tidelake.plans.registry import query
from tidelake.session import new_folder


def _probability(x):
    weights = (0.02, -0.004, 0.3)
    return 1 / (1 + F.exp(-(x[0] * weights[0] + x[1] * weights[1] + x[2] * weights[2] - 1.5)))


@query("q_K21_calibrator_file", v.with_views(f"WITH r AS (SELECT doc_id, p AS raw FROM v_scores) SELECT doc_id, round({_CALIBRATED_SQL}, 6) AS calibrated FROM r"))
def calibrator_file(spark, sf):
    """A calibrator written, read, and applied to every score."""
    from tidelake.functions.market import interpolated

    path = new_folder(spark)
    serving.write_calibrator(spark, path, (_X, _Y), feature_columns=["p"])
    read = serving.read_artifact(spark, path)
    return v.scores(spark, sf).select("doc_id", F.round(interpolated(F.col("p"), read["x_thresholds"], read["y_thresholds"]), 6).alias("calibrated"))


@query("q_V02_refreshed_decisions", v.with_views(f"WITH {_GOLD_SQL}, d AS (SELECT *, row_number() OVER (ORDER BY ts_ms DESC, tid DESC) AS nth FROM c WHERE ts_ms // 86400000 = (SELECT max(ts_ms // 86400000) FROM c)), w AS (SELECT *, CASE WHEN nth <= 20 THEN 2 ELSE 1 END AS run, cal >= CASE WHEN nth <= 20 THEN 0.3 ELSE 0.45 END AS withheld FROM d WHERE nth <= 50) SELECT tid, run::bigint AS run, round(cal, 6) AS score, CASE WHEN withheld THEN 'withhold_quote' ELSE 'quote' END AS action, CASE WHEN withheld AND cal >= 0.75 THEN 'critical' WHEN withheld THEN 'high' WHEN cal >= 0.45 THEN 'medium' ELSE 'low' END AS severity FROM w"))
def refreshed_decisions(spark, sf):
    """The newest 50 fills of the newest day decided, the newest 20 of them again under another threshold; a third run lacks its report."""
    root = new_folder(spark)
    gold = lake.write_table(v.fills(spark, sf).withColumn("coin", F.col("coin").cast("string")), root, "training_rows")
    at = {"calibrator": f"{root}/calibrator", "report": f"{root}/report"}
    serving.write_artifact(spark, at["report"], {"model_name": "logit"})
    for run, (limit, threshold) in enumerate(((50, 0.45), (20, 0.3)), 1):
        serving.write_calibrator(spark, at["calibrator"], (_X, _Y), feature_columns=["px", "sz", "maker_side"], decision_threshold=threshold)
        serving.refresh_decisions(spark, gold, _probability, at, root, run, limit)
    serving.refresh_decisions(spark, gold, _probability, at | {"report": f"{root}/none"}, root, 3, 5)
    return serving.current_decisions(spark, root).select("tid", "run", F.round("calibrated_score", 6).alias("score"), "action", "severity")


@query("q_V07_snapshots", v.with_views("WITH b AS (SELECT coin, arg_max(struct_pack(ts_ms := ts_ms, bid_px := bid_px, ask_px := ask_px), (ts_ms, tie)) AS b FROM v_book GROUP BY coin), x AS (SELECT coin, arg_max(struct_pack(funding := funding, oracle_px := oracle_px, mark_px := mark_px), (ts_ms, tie)) AS x FROM v_ctx GROUP BY coin) SELECT b.coin::varchar || '-PERP' AS symbol, b.ts_ms, round((b.bid_px + b.ask_px) / 2, 6) AS mid, round((b.ask_px - b.bid_px) / ((b.bid_px + b.ask_px) / 2) * 10000, 6) AS spread_bps, round(x.funding, 9) AS funding, round((x.mark_px - x.oracle_px) / x.oracle_px * 10000, 6) + 0 AS basis_bps FROM b LEFT JOIN x USING (coin)"))
def snapshots(spark, sf):
    rows = serving.snapshots(v.book(spark, sf), v.contexts(spark, sf))
    return rows.select("symbol", "ts_ms", F.round("mid", 6).alias("mid"), F.round("spread_bps", 6).alias("spread_bps"), F.round("funding", 9).alias("funding"), (F.round("basis_bps", 6) + 0).alias("basis_bps"))


@query("q_V07_recent_candles", v.with_views("SELECT coin, ts_ms, close, tie FROM (SELECT *, max(ts_ms) OVER (PARTITION BY coin) AS m FROM v_bars) WHERE ts_ms >= m - 10080 * 60000"))
def recent_candles(spark, sf):
    """The last week of each coin."""
    return serving.recent_candles(v.bars(spark, sf), 10_080).select("coin", "ts_ms", "close", "tie")


def _hash_sql(*columns: str) -> str:
    each = "sha256(concat_ws('|', " + ", ".join(columns) + "))"
    return "sha256(concat_ws(',', " + ", ".join(f"sum(('0x' || substr({each}, {8 * i + 1}, 8))::bigint)::varchar" for i in range(8)) + "))"


@query("q_V29_scenario_manifests", v.with_views(f"WITH l AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY ts_ms, sequence) - 1 AS i, count(*) OVER (PARTITION BY scenario_id) AS n FROM v_orders), u AS (SELECT *, n = 1 OR i >= floor(n * 0.25) AS unsafe FROM l) SELECT scenario_id, 'quote_stuffing' AS family, count(*) AS event_count, bool_or(unsafe) AS unsafe, {_hash_sql('order_id', 'ts_ms', 'action', 'side')} AS event_hash, {_hash_sql('order_id', 'unsafe')} AS label_hash FROM u GROUP BY scenario_id"))
def scenario_manifests(spark, sf):
    events = v.orders(spark, sf).withColumn("family", F.lit("quote_stuffing")).withColumnRenamed("order_id", "event_id")
    labels = scenarios.label_unsafe(events, "scenario_id", ["ts_ms", "sequence"]).select("scenario_id", "event_id", "unsafe")
    return serving.scenario_manifests(events, labels, ["event_id", "ts_ms", "action", "side"])


@query("q_V29_example_rows", v.with_views("WITH l AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY ts_ms, sequence) - 1 AS i, count(*) OVER (PARTITION BY scenario_id) AS n FROM v_orders) SELECT scenario_id, order_id AS event_id, ts_ms AS timestamp_ms, 'quote_stuffing' AS family, n = 1 OR i >= floor(n * 0.25) AS unsafe, 'agent_order:' || action || ':' || side AS mark FROM l"))
def example_rows(spark, sf):
    events = v.orders(spark, sf).withColumn("family", F.lit("quote_stuffing")).withColumnRenamed("order_id", "event_id")
    rows = scenarios.label_unsafe(events, "scenario_id", ["ts_ms", "sequence"])
    return rows.select("scenario_id", "event_id", F.col("ts_ms").alias("timestamp_ms"), "family", "unsafe", F.concat_ws(":", F.lit("agent_order"), "action", "side").alias("mark"))
