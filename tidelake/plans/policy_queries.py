"""Rule engine, severities, cases, actions, novelty, promotion, scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.functions import market
from tidelake.operators import policy, scenarios
from tidelake.plans import adapters as v
from tidelake.plans.registry import query

_FEATURES = {
    "burst": "(k % 20) * 1.0", "quantity_sum": "(k % 7) * 0.75", "sell_ratio": "(k % 11) / 10.0", "min_interarrival": "(k % 13) * 2.0", "drift": "(k % 9) * 8.0", "cancel_rate": "(k % 10) / 15.0", "self_cross": "(k % 5) * 1.0", "agents": "(k % 4) * 1.0", "price_range": "(k % 17) * 6.0", "quantity_max": "(k % 3) / 20.0",
}
_FEATURES_SQL = ", ".join(f"({e.replace('1.0', '1e0').replace('0.75', '0.75e0').replace('2.0', '2e0').replace('8.0', '8e0').replace('6.0', '6e0').replace('10.0', '10e0').replace('15.0', '15e0').replace('20.0', '20e0')})::double AS {n}" for n, e in _FEATURES.items())
_RULED_SQL = f"""x AS (SELECT event_id, user_id, ts_ms, {_FEATURES_SQL} FROM ev), r AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {p} THEN '{n}' END" for n, p in policy.RULES)}], lambda s: s IS NOT NULL) AS rules FROM x),
a AS (SELECT *, CASE WHEN len(rules) >= 2 THEN 'block' WHEN len(rules) = 1 THEN 'alert' ELSE 'allow' END AS action, CASE WHEN len(rules) >= 2 THEN 0.88 WHEN len(rules) = 1 THEN 0.58 ELSE 0.15 END::double AS risk_score FROM r),
s AS (SELECT *, CASE WHEN action = 'block' THEN 'critical' WHEN action = 'alert' THEN 'high' WHEN risk_score >= 0.45 THEN 'medium' ELSE 'low' END AS severity FROM a)"""


def ruled(spark, sf):
    rows = v.events(spark, sf).select("event_id", "user_id", "ts_ms", *[F.expr(e).cast("double").alias(n) for n, e in _FEATURES.items()])
    rows = rows.withColumn("rules", policy.matched_rules()).withColumn("action", policy.rule_action("rules"))
    return rows.withColumn("risk_score", policy.by_name("action", policy.RISK_SCORES)).withColumn("severity", policy.tick_severity())


@query("q_P11_rule_engine", v.with_views(f"WITH {_RULED_SQL} SELECT event_id, array_to_string(rules, ',') AS rules, action, risk_score, severity FROM s"))
def rule_engine(spark, sf):
    return ruled(spark, sf).select("event_id", F.array_join("rules", ",").alias("rules"), "action", "risk_score", "severity")


@query("q_A42_rule_coverage", v.with_views(f"WITH {_RULED_SQL} SELECT rule, count(*) AS n, count(DISTINCT user_id) AS n_users FROM (SELECT user_id, unnest(rules) AS rule FROM s) GROUP BY rule"))
def rule_coverage(spark, sf):
    return ruled(spark, sf).select("user_id", F.explode("rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"))


@query("q_P16_cases", v.with_views(f"""WITH {_RULED_SQL}, c AS (SELECT event_id, rules, burst, cancel_rate, risk_score, severity FROM s WHERE risk_score >= 0.45 OR action <> 'allow' UNION ALL SELECT doc_id, ['promoted_markout_threshold'], 0, 0, p, CASE WHEN p >= 0.75 THEN 'critical' ELSE 'medium' END FROM v_scores WHERE p >= 0.45)
SELECT event_id, CASE WHEN list_contains(rules, 'promoted_markout_threshold') THEN 'Adverse-selection markout risk' WHEN list_has_all(rules, ['one_sided_sell_pressure', 'cancel_rate_spike']) THEN 'Spoofing / layering' WHEN list_has_all(rules, ['rapid_order_interarrival', 'cancel_rate_spike']) THEN 'Quote stuffing' WHEN list_has_any(rules, ['sharp_buy_price_drift', 'stop_run_or_feedback_sweep']) THEN 'Momentum ignition'
WHEN burst > 12 THEN 'Bursty unsafe agent behavior (unclassified)' WHEN cancel_rate > 0.5 THEN 'High cancel-rate behavior' ELSE 'Generic anomalous flow' END AS behaviour, round(least(0.99, 0.4 + 0.6 * risk_score), 6) AS confidence, CASE severity WHEN 'critical' THEN 'block_simulated_agent' WHEN 'high' THEN 'critical_alert' WHEN 'medium' THEN 'warning_alert' ELSE 'no_action' END AS recommended FROM c"""))  # fmt: skip
def cases(spark, sf):
    """Cases from ticks and from scored fills; the latter match the markout rule alone."""
    ticks = ruled(spark, sf).filter("risk_score >= 0.45 or action <> 'allow'").select("event_id", "rules", "burst", "cancel_rate", "risk_score", "severity")
    fills = v.scores(spark, sf).filter("p >= 0.45").select(F.col("doc_id").alias("event_id"), F.array(F.lit(policy.MARKOUT_RULE)).alias("rules"), F.lit(0.0).alias("burst"), F.lit(0.0).alias("cancel_rate"), F.col("p").alias("risk_score"), F.when(F.col("p") >= 0.75, "critical").otherwise("medium").alias("severity"))
    rows = ticks.unionByName(fills).withColumn("confidence", policy.case_confidence("risk_score"))
    return rows.select("event_id", policy.behaviour("rules").alias("behaviour"), F.round("confidence", 6).alias("confidence"), policy.case_action().alias("recommended"))


@query("q_A34_posture", v.with_views(f"WITH {_RULED_SQL}, d AS (SELECT user_id, event_id, CASE severity WHEN 'critical' THEN 'block_simulated_agent' WHEN 'high' THEN 'critical_alert' ELSE 'no_action' END AS act, CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 ELSE 1 END AS pr FROM s) SELECT user_id, arg_max(act, (pr, -event_id)) AS posture FROM d GROUP BY user_id"))
def posture(spark, sf):
    """The worst action per user, the first one among equals."""
    rows = ruled(spark, sf).withColumn("confidence", policy.case_confidence("risk_score")).withColumn("recommended", policy.case_action())
    return rows.groupBy("user_id").agg(F.max_by("recommended", F.struct(policy.by_name("recommended", policy.PRIORITIES).alias("p"), -F.col("event_id"))).alias("posture"))


@query("q_A33_plan_summary", v.with_views(f"WITH {_RULED_SQL} SELECT user_id, count(*) FILTER (action <> 'allow') AS alerts, max(risk_score) AS peak, count(*) FILTER (severity = 'critical') AS critical FROM s GROUP BY user_id"))
def plan_summary(spark, sf):
    return ruled(spark, sf).groupBy("user_id").agg(F.count_if(F.col("action") != "allow").alias("alerts"), F.max("risk_score").alias("peak"), F.count_if(F.col("severity") == "critical").alias("critical"))


@query("q_T03_top_alerts", v.with_views(f"WITH {_RULED_SQL} SELECT event_id, risk_score FROM s WHERE action <> 'allow' ORDER BY risk_score DESC, ts_ms, event_id LIMIT 5"))
def top_alerts(spark, sf):
    return ruled(spark, sf).filter("action <> 'allow'").orderBy(F.desc("risk_score"), "ts_ms", "event_id").limit(5).select("event_id", "risk_score")


@query("q_J18_novelty", v.with_views(f"""WITH {_RULED_SQL}, n AS (SELECT event_id, rules, user_id % 6 AS name FROM s WHERE event_id % 50 = 0), m AS (SELECT rules, user_id % 6 AS name, count(*) AS n, min(event_id) AS only FROM s GROUP BY ALL)
SELECT n.event_id, round(min(greatest(0, 1 - greatest(CASE WHEN len(n.rules) > 0 AND len(m.rules) > 0 THEN len(list_intersect(n.rules, m.rules)) / len(list_distinct(n.rules || m.rules)) ELSE 0 END, CASE WHEN n.name = m.name THEN 0.6 ELSE 0 END))), 9) AS novelty FROM n, m WHERE m.n > 1 OR m.only <> n.event_id GROUP BY 1"""))  # fmt: skip
def novelty(spark, sf):
    """How new each 50th case is against all others, which are met as distinct signatures (rules, name) and not as rows."""
    rows = ruled(spark, sf).withColumn("name", F.expr("user_id % 6"))
    # at most 2^9 sets of rules times 6 names
    shelf = rows.groupBy(F.col("rules").alias("seen_rules"), F.col("name").alias("seen_name")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("only"))
    met = rows.filter("event_id % 50 = 0").join(F.broadcast(shelf), (F.col("n") > 1) | (F.col("only") != F.col("event_id")))
    return met.groupBy("event_id").agg(F.round(F.min(policy.best_overlap_novelty("rules", "name", "seen_rules", "seen_name")), 9).alias("novelty"))


@query("q_P13_probability_label", v.with_views("SELECT doc_id, CASE WHEN p >= 0.75 THEN 'BLOCK' WHEN p >= 0.4 THEN 'ALERT' ELSE 'ALLOW' END AS label FROM v_scores"))
def probability_label(spark, sf):
    return v.scores(spark, sf).select("doc_id", policy.probability_label(F.col("p")).alias("label"))


@query("q_P14_fill_severity", v.with_views("SELECT doc_id, CASE WHEN p >= 0.6 THEN 'withhold_quote' ELSE 'quote' END AS action, CASE WHEN p >= 0.75 THEN 'critical' WHEN p >= 0.6 THEN 'high' WHEN p >= 0.45 THEN 'medium' ELSE 'low' END AS severity FROM v_scores"))
def fill_severity(spark, sf):
    rows = v.scores(spark, sf).withColumn("calibrated", F.col("p")).withColumn("action", F.when(F.col("p") >= 0.6, "withhold_quote").otherwise("quote"))
    return rows.select("doc_id", "action", policy.fill_severity().alias("severity"))


@query("q_P26_promotion", v.with_views("""WITH m AS (SELECT scenario, avg(markout) AS lift, avg(p) AS auc, avg((p - y::int) ** 2) AS brier, min(p) + 0.9 AS lat, count(*) % 2 = 0 AS safe FROM v_scores GROUP BY scenario), c AS (SELECT a.scenario AS champion, b.scenario AS challenger, (b.lift - a.lift >= 0)::int + (b.auc >= a.auc)::int + (b.brier <= a.brier)::int + (b.lat <= 1)::int + b.safe::int AS passed, b.safe FROM m a JOIN m b ON a.scenario <> b.scenario)
SELECT champion, challenger, passed, CASE WHEN NOT safe THEN 'reject' WHEN passed >= 4 THEN 'promote' WHEN passed >= 3 THEN 'needs_more_data' ELSE 'reject' END AS verdict FROM c"""))  # fmt: skip
def promotion(spark, sf):
    m = v.scores(spark, sf).groupBy("scenario").agg(F.struct(F.avg("markout").alias("markout_lift"), F.avg("p").alias("pr_auc"), F.avg(F.pow(F.col("p") - F.col("y").cast("double"), 2)).alias("brier"), (F.min("p") + 0.9).alias("latency_ms"), (F.count(F.lit(1)) % 2 == 0).alias("leakage_safe")).alias("m"))
    pairs = m.select(F.col("scenario").alias("champion"), F.col("m").alias("a")).join(F.broadcast(m.select(F.col("scenario").alias("challenger"), F.col("m").alias("b"))), F.col("champion") != F.col("challenger"))
    passed, verdict = policy.promotion_verdict("a", "b")
    return pairs.select("champion", "challenger", passed.alias("passed"), verdict.alias("verdict"))


@query("q_P01_book_features", v.with_views("SELECT tie, round((bid_px + ask_px) / 2, 6) AS mid, round((ask_px - bid_px) / ((bid_px + ask_px) / 2) * 10000, 6) AS spread_bps, round((bid_px * ask_sz + ask_px * bid_sz) / (bid_sz + ask_sz), 6) AS microprice, round((bid_sz - ask_sz) / (bid_sz + ask_sz), 6) + 0 AS top_imbalance FROM v_book"))
def book_features(spark, sf):
    return v.book(spark, sf).select("tie", F.round(market.mid(), 6).alias("mid"), F.round(market.spread_bps(), 6).alias("spread_bps"), F.round(market.microprice(), 6).alias("microprice"), (F.round(market.top_imbalance(), 6) + 0).alias("top_imbalance"))


@query("q_K04_silver_fills", v.with_views("SELECT tid, round(px * sz, 6) AS notional, CASE WHEN coalesce(crossed, false) THEN -1 ELSE 1 END * CASE side WHEN 'B' THEN 1 ELSE -1 END AS maker_side, round(CASE WHEN px * sz > 0 THEN fee / (px * sz) * 10000 END, 6) AS fee_bps FROM v_fills"))
def silver_fills(spark, sf):
    return v.fills(spark, sf).select("tid", F.round(F.col("px") * F.col("sz"), 6).alias("notional"), market.maker_side().alias("maker_side"), F.round(market.fee_bps(), 6).alias("fee_bps"))


@query("q_P03_basis", v.with_views("SELECT tie, round(CASE WHEN oracle_px > 0 THEN (mark_px - oracle_px) / oracle_px * 10000 END, 6) AS basis_bps FROM v_ctx"))
def basis(spark, sf):
    return v.contexts(spark, sf).select("tie", F.round(market.basis_bps(), 6).alias("basis_bps"))


@query("q_P09_constraints", v.with_views("SELECT count(*) FILTER (bid_px >= ask_px) AS crossed, count(*) FILTER (bid_sz <= 0 OR ask_sz <= 0) AS empty, (SELECT count(*) FILTER (high < greatest(open, close) OR low > least(open, close)) FROM v_bars) AS bad_bars FROM v_book"))
def constraints(spark, sf):
    bad = v.bars(spark, sf).agg(F.count_if((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))).alias("bad_bars"))
    return v.book(spark, sf).agg(F.count_if(F.col("bid_px") >= F.col("ask_px")).alias("crossed"), F.count_if((F.col("bid_sz") <= 0) | (F.col("ask_sz") <= 0)).alias("empty")).join(F.broadcast(bad))


@query("q_P19_unsafe_labels", v.with_views("WITH i AS (SELECT order_id, scenario_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY scenario_id) AS n, CASE scenario_id % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 0.6 ELSE 0.4 END AS f FROM v_orders WINDOW w AS (PARTITION BY scenario_id ORDER BY ts_ms, sequence)) SELECT order_id, n = 1 OR i >= floor(n * f) AS unsafe FROM i"))
def unsafe_labels(spark, sf):
    families = F.element_at(F.array(*map(F.lit, ("quote_stuffing", "spoofing_layering", "momentum_ignition", "volatility_feedback"))), (F.col("scenario_id") % 4 + 1).cast("int"))
    return scenarios.label_unsafe(v.orders(spark, sf).withColumn("family", families), "scenario_id", ["ts_ms", "sequence"]).select("order_id", "unsafe")


_GENERATED_SQL = v.with_views("""WITH i AS (SELECT tie, tie % 30 AS i, close AS m FROM v_bars)
SELECT 'quote_stuffing' AS family, tie, 5 * i AS at_ms, CASE WHEN i % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, round(1.3e-8 + m * CASE WHEN i % 2 = 0 THEN 0.9999 ELSE 1.0001 END, 6)::double AS price, 0.001::double AS quantity FROM i
UNION ALL SELECT 'runaway_inventory', tie, 70 * i, 'buy', round(1.3e-8 + m * (1 + i * 3e-5), 6), round(0.01 + 0.002 * i, 9)::double FROM i
UNION ALL SELECT 'inventory_rebalancer', tie, 750 * i, CASE WHEN i % 3 = 0 THEN 'sell' ELSE 'buy' END, round(1.3e-8 + m, 6), 0.004 FROM i
UNION ALL SELECT 'coordinated_burst', tie, CASE WHEN i % 5 = 0 THEN 120 ELSE 12 END * i, CASE WHEN i % 3 = 0 THEN 'buy' ELSE 'sell' END, round(1.3e-8 + m * CASE WHEN i % 3 = 0 THEN 1.0002 ELSE 0.9998 END, 6), 0.04 FROM i
UNION ALL SELECT 'volatility_feedback', tie, 20 * i, CASE WHEN i % 2 = 0 THEN 'buy' ELSE 'sell' END, round(1.3e-8 + m * (1 + CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END * (0.001 + i * 2e-5)), 6), round(0.02 + (i % 4) * 0.01, 9) FROM i""")


@query("q_M11_generated_orders", _GENERATED_SQL)
def generated_orders(spark, sf):
    """Of each bar one order of every family around the bar's close."""
    families = ("quote_stuffing", "runaway_inventory", "inventory_rebalancer", "coordinated_burst", "volatility_feedback")
    numbered = v.bars(spark, sf).select("tie", (F.col("tie") % 30).alias("i"), "close")
    rows = scenarios.orders_of(numbered, "close", ["tie"]).filter(F.col("family").isin(*families))
    return rows.select("family", "tie", "at_ms", "side", F.round(F.col("price") + 1.3e-8, 6).alias("price"), F.round("quantity", 9).alias("quantity"))

