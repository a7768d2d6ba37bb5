"""Cases, judgements, variants and screen rows that the other query modules leave."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelake.functions import market
from tidelake.operators import policy, scenarios, stats, temporal
from tidelake.plans import adapters as v
from tidelake.plans.policy_queries import _RULED_SQL, ruled
from tidelake.plans.registry import query
from tidelake.session import table

_MID = 101.0


def _lookup_sql(column: str, values: dict) -> str:
    return f"CASE {column} {' '.join(f"WHEN '{k}' THEN '{x}'" for k, x in values.items())} END"


_ACTION_SQL = "CASE severity WHEN 'critical' THEN 'block_simulated_agent' WHEN 'high' THEN 'critical_alert' WHEN 'medium' THEN 'warning_alert' ELSE CASE WHEN confidence < 0.3 THEN 'monitor' ELSE 'no_action' END END"


@query("q_P06_markout_bps", v.with_views("SELECT f.tid, round(CASE f.side WHEN 'B' THEN 1 ELSE -1 END * ((b.bid_px + b.ask_px) / 2 - f.px) / f.px * 10000, 6) + 0e0 AS markout FROM v_fills f ASOF JOIN v_book b ON f.coin = b.coin AND f.ts_ms >= b.ts_ms"))
def markout_bps(spark, sf):
    rows = temporal.asof_backward(v.fills(spark, sf), v.book(spark, sf, v.IN_TIME), "coin", "b_")
    return rows.select("tid", (F.round(market.markout_bps(market.side_sign(), market.mid("b_bid_px", "b_ask_px"), F.col("px")), 6) + 0.0).alias("markout"))


@query("q_P17_next_step", v.with_views(f"WITH {_RULED_SQL} SELECT event_id, {_lookup_sql('severity', policy.NEXT_STEPS)} AS next_step, round(least(0.99e0, 0.4e0 + 0.6e0 * risk_score), 9) AS confidence FROM s"))
def next_step(spark, sf):
    return ruled(spark, sf).select("event_id", policy.by_name("severity", policy.NEXT_STEPS).alias("next_step"), F.round(policy.case_confidence("risk_score"), 9).alias("confidence"))


@query("q_P18_case_action", v.with_views(f"WITH {_RULED_SQL}, cases AS (SELECT event_id, severity, risk_score / 2 AS confidence FROM s), acts AS (SELECT event_id, {_ACTION_SQL} AS action FROM cases) SELECT event_id, action, {_lookup_sql('action', policy.RATIONALES)} AS rationale FROM acts"))
def case_action(spark, sf):
    cases = ruled(spark, sf).select("event_id", "severity", (F.col("risk_score") / 2).alias("confidence")).select("event_id", policy.case_action().alias("action"))
    return cases.withColumn("rationale", policy.by_name("action", policy.RATIONALES))


@query("q_P20_safety_variant", v.with_views(f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY ts_ms, sequence) - 1 AS i, min(ts_ms) OVER (PARTITION BY scenario_id) AS t0, min(price) OVER (PARTITION BY scenario_id) < max(price) OVER (PARTITION BY scenario_id) AS several FROM v_orders)
SELECT order_id, true AS unsafe, t0 + 8 * i AS at_ms, round(CASE WHEN several THEN price * (1 + 8e-5 * i) ELSE price END, 6) AS price, round(greatest(quantity, 0.08e0), 9) AS quantity FROM o
UNION ALL SELECT order_id, false, t0 + 250 * i, round({_MID}e0 * (1 + CASE WHEN i % 2 = 0 THEN -5e-5 ELSE 5e-5 END), 6), round(least(quantity, 0.01e0), 9) FROM o"""))  # fmt: skip
def safety_variant(spark, sf):
    orders = v.orders(spark, sf).withColumnsRenamed({"ts_ms": "at_ms", "sequence": "i"})
    both = [scenarios.safety_variant(orders, "scenario_id", _MID, unsafe).select("order_id", F.lit(unsafe).alias("unsafe"), F.col("at_ms").cast("long").alias("at_ms"), F.round("price", 6).alias("price"), F.round("quantity", 9).alias("quantity")) for unsafe in (True, False)]
    return both[0].unionByName(both[1])


_SIDES = {
    "c": {"pr_auc": "CASE k % 11 WHEN 0 THEN NULL WHEN 1 THEN cast('NaN' AS double) ELSE (k % 20) / 20e0 END", "f1": "(k % 17) / 17e0", "holdout": "CASE WHEN event_id % 7 <> 0 THEN (k % 19) / 19e0 END", "p99_ms": "cast(1 + k % 5 AS double)"},
    "i": {"pr_auc": "(event_id % 20) / 20e0", "f1": "(event_id % 17) / 17e0", "holdout": "(event_id % 19) / 19e0", "p99_ms": "cast(event_id % 4 AS double)"},
}
_LIFTS = {"lift": "CASE WHEN event_id % 3 = 0 THEN (k - 50) / 10e0 END", "holdout_lift": "CASE WHEN event_id % 5 = 0 THEN (k - 30) / 10e0 END"}
_JUDGED = ", ".join(f"{e} AS {n}" for n, e in {f"{side}_{m}": e for side, metrics in _SIDES.items() for m, e in metrics.items()}.items()) + ", " + ", ".join(f"{e} AS {n}" for n, e in _LIFTS.items())


@query("q_P27_judge", v.with_views(f"""WITH m AS (SELECT event_id, {_JUDGED} FROM ev), w AS (SELECT *,
CASE WHEN c_pr_auc IS NULL OR i_pr_auc IS NULL THEN 0 WHEN isnan(c_pr_auc) OR isnan(i_pr_auc) THEN 1 ELSE (c_pr_auc - i_pr_auc >= -0.005e0)::int END + (c_f1 - i_f1 >= -0.01e0)::int + CASE WHEN c_holdout IS NULL THEN 0 ELSE (c_holdout - i_holdout >= 0.01e0)::int END
+ CASE WHEN i_p99_ms <= 0 THEN 1 ELSE (c_p99_ms / i_p99_ms <= 1.3e0)::int END + CASE WHEN c_pr_auc IS NULL OR isnan(c_pr_auc) OR c_holdout IS NULL THEN 1 ELSE (c_pr_auc - c_holdout <= i_pr_auc - i_holdout + 0.05e0)::int END AS votes FROM m)
SELECT event_id, votes, CASE WHEN lift < 0 OR holdout_lift < 0 THEN 'reject' WHEN votes >= 3 THEN 'promote' WHEN votes >= 1 THEN 'needs_more_data' ELSE 'reject' END AS verdict FROM w"""))  # fmt: skip
def judge(spark, sf):
    structs = [f"named_struct({', '.join(f"'{m}', {e}" for m, e in metrics.items())}) AS {side}" for side, metrics in _SIDES.items()]
    rows = v.events(spark, sf).selectExpr("event_id", *structs, *[f"{e} AS {n}" for n, e in _LIFTS.items()]).withColumn("votes", policy.judge_votes("c", "i"))
    return rows.select("event_id", "votes", policy.judge_verdict(F.col("votes"), F.col("lift"), F.col("holdout_lift")).alias("verdict"))


_RAW_COIN = "concat('  ', event_type, CASE k % 3 WHEN 0 THEN '-perp' WHEN 1 THEN '-PERP ' ELSE ' ' END)"


@query("q_P29_normalised_coins", v.with_views(f"SELECT coin, count(*) AS n FROM (SELECT regexp_replace(upper(trim({_RAW_COIN})), '-PERP$', '') AS coin FROM ev) GROUP BY coin"))
def normalised_coins(spark, sf):
    return v.events(spark, sf).selectExpr(f"{_RAW_COIN} AS coin").groupBy(market.normalised_coin().alias("coin")).agg(F.count(F.lit(1)).alias("n"))


@query("q_P30_evasion", v.with_views(f"""WITH {_RULED_SQL}, d AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 0.3e0 WHEN 1 THEN 0.55e0 ELSE 0.85e0 END AS z FROM s) SELECT event_id, round(min_interarrival + 200 * z, 6) AS min_interarrival, round(greatest(0.5e0, burst * (1 - 0.6e0 * z)), 6) AS burst, round(greatest(0.001e0, quantity_max * (1 - 0.5e0 * z)), 6) AS quantity_max,
round(greatest(0, drift * (1 - 0.4e0 * z)), 6) AS drift, round(greatest(0.02e0, cancel_rate * (1 - 0.55e0 * z)), 6) AS cancel_rate FROM d"""))  # fmt: skip
def evasion(spark, sf):
    rows = ruled(spark, sf).withColumn("difficulty", F.element_at(F.array(*map(F.lit, policy.EVASION_SCALES)), (F.col("event_id") % 3 + 1).cast("int")))
    return rows.select("event_id", *[F.round(c, 6).alias(n) for n, c in policy.evaded().items()])


@query("q_P33_moves", v.with_views("""SELECT tie, CASE WHEN close >= open THEN '+' ELSE '' END || printf('%.2f', close - open) || ' (' || CASE WHEN close >= open THEN '+' ELSE '' END || printf('%.2f', (close - open) / open * 100) || '%)' AS move, printf('%.3f', (high - low) / close * 100) || '%' AS impact FROM v_bars"""))
def moves(spark, sf):
    change = F.col("close") - F.col("open")
    sign = F.when(change >= 0, "+").otherwise("")
    move = F.concat(sign, F.format_string("%.2f", change), F.lit(" ("), sign, F.format_string("%.2f", change / F.col("open") * 100), F.lit("%)"))
    return v.bars(spark, sf).select("tie", move.alias("move"), F.concat(F.format_string("%.3f", (F.col("high") - F.col("low")) / F.col("close") * 100), F.lit("%")).alias("impact"))


@query("q_A13_log_loss", v.with_views("SELECT scenario, round(avg(CASE WHEN y THEN -ln(greatest(least(p, 1 - 1e-9), 1e-9)) ELSE -ln(1 - greatest(least(p, 1 - 1e-9), 1e-9)) END), 9) AS log_loss FROM v_scores GROUP BY scenario"))
def sequence_log_loss(spark, sf):
    """The sequence models' loss, clipped closer to 0 and 1 than the report's."""
    return v.scores(spark, sf).groupBy("scenario").agg(F.round(stats.log_loss(1e-9), 9).alias("log_loss"))


@query("q_V10_market_regime", v.with_views("SELECT CASE WHEN k % 7 >= 4 THEN 'thin liquidity' WHEN (k % 10) / 10e0 >= 0.75 THEN 'volatile' ELSE 'calm' END AS regime, count(*) AS n FROM ev GROUP BY regime"))
def market_regime(spark, sf):
    return v.events(spark, sf).groupBy(policy.market_regime(F.col("k") % 7, F.col("k") % 10 / 10).alias("regime")).agg(F.count(F.lit(1)).alias("n"))


@query("q_V12_run_percentages", v.with_views("SELECT scenario, round(avg(p) * 100, 1) AS pr_auc_pct, round(avg(y::int) * 100, 1) AS f1_pct, CASE scenario WHEN 'en' THEN 'replay' WHEN 'de' THEN 'lake' END AS provenance FROM v_scores GROUP BY scenario"))
def run_percentages(spark, sf):
    runs = v.scores(spark, sf).groupBy("scenario").agg(F.round(F.avg("p") * 100, 1).alias("pr_auc_pct"), F.round(F.avg(F.col("y").cast("int")) * 100, 1).alias("f1_pct"))
    return runs.withColumn("provenance", policy.by_name("scenario", {"en": "replay", "de": "lake"}))


@query("q_V15_model_overlay", v.with_views("WITH m AS (SELECT scenario, avg(markout) AS lift FROM v_scores GROUP BY scenario), c AS (SELECT arg_min(lift, scenario) AS lift, min(scenario) AS champion FROM m) SELECT doc_id, m.scenario AS model, round(least(1, greatest(0, p + (m.lift - c.lift) / 100)), 6) AS risk FROM v_scores s JOIN c ON s.scenario = c.champion CROSS JOIN m"))
def model_overlay(spark, sf):
    """The champion's live series as each model would show it; models are a handful, and their lifts ride along as one map."""
    rows = v.scores(spark, sf)
    lifts = rows.groupBy("scenario").agg(F.avg("markout").alias("lift")).agg(F.map_from_entries(F.collect_list(F.struct("scenario", "lift"))).alias("lifts"), F.min("scenario").alias("champion"))
    series = rows.join(F.broadcast(lifts), F.col("scenario") == F.col("champion")).select("doc_id", "p", F.col("lifts")[F.col("champion")].alias("own"), F.explode("lifts").alias("model", "lift"))
    shifted = F.col("p") + (F.col("lift") - F.col("own")) / 100
    return series.select("doc_id", "model", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), shifted)), 6).alias("risk"))


@query("q_V17_audit_rows", """WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM (SELECT DISTINCT conv_id, turn, min(role) OVER (PARTITION BY conv_id, turn) AS role FROM conversations))
SELECT conv_id, regexp_replace(replace(upper(role[1]) || role[2:] || 'ReviewAgent', 'Agent', ''), '([a-z])([A-Z])', '\\1 \\2', 'g') AS agent, 'Step ' || i || ' of ' || least(n, 6) AS step, CASE turn % 3 WHEN 0 THEN 'Block' WHEN 1 THEN 'Escalate' ELSE 'Proceed' END AS decision FROM t WHERE i <= 6""")  # fmt: skip
def audit_rows(spark, sf):
    """The first six runs of each loop in order, with the class of the decision that stands at the same place."""
    by = Window.partitionBy("conv_id")
    runs = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    runs = runs.withColumn("i", F.row_number().over(by.orderBy("turn"))).withColumn("n", F.count(F.lit(1)).over(by)).filter("i <= 6")
    name = F.concat(F.initcap("role"), F.lit("ReviewAgent"))
    decision = F.element_at(F.array(*map(F.lit, ("block_simulated_agent", "warning_alert", "no_action"))), (F.col("turn") % 3 + 1).cast("int"))
    return runs.select(
        "conv_id", F.regexp_replace(F.replace(name, F.lit("Agent"), F.lit("")), "([a-z])([A-Z])", "$1 $2").alias("agent"), F.concat(F.lit("Step "), F.col("i"), F.lit(" of "), F.least("n", F.lit(6))).alias("step"),
        F.when(decision.contains("block"), "Block").when(decision.contains("alert"), "Escalate").otherwise("Proceed").alias("decision"),
    )


@query("q_V19_loop_progress", v.with_views("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY ts_ms, sequence) - 1 AS i FROM v_orders)
SELECT scenario_id, CASE WHEN scenario_id % 3 = 1 THEN scenario_id * 1000 ELSE greatest(0, max(ts_ms) - min(ts_ms)) END AS duration_ms, floor(count(*) FILTER (action = 'new') / count(*) * 100 + 0.5)::bigint AS percent, CASE WHEN scenario_id % 2 = 0 THEN coalesce(min(i) FILTER (action <> 'new'), count(*) - 1) ELSE count(*) - 1 END AS active FROM o GROUP BY scenario_id"""))  # fmt: skip
def loop_progress(spark, sf):
    """A loop's duration as given or else from its ends, the share of steps done, and the step at work."""
    steps = v.orders(spark, sf).withColumn("i", F.row_number().over(Window.partitionBy("scenario_id").orderBy("ts_ms", "sequence")) - 1).withColumn("given", F.when(F.col("scenario_id") % 3 == 1, F.col("scenario_id") * 1000))
    n, done, last = F.count(F.lit(1)), F.count_if(F.col("action") == "new"), F.count(F.lit(1)) - 1
    first_open = F.min(F.when(F.col("action") != "new", F.col("i"))).cast("long")
    return steps.groupBy("scenario_id").agg(
        F.coalesce(F.max("given"), F.greatest(F.lit(0), F.max("ts_ms") - F.min("ts_ms"))).alias("duration_ms"), F.floor(done / n * 100 + 0.5).alias("percent"),
        F.when(F.col("scenario_id") % 2 == 0, F.coalesce(first_open, last)).otherwise(last).alias("active"),
    )


@query("q_V20_input_checks", v.with_views("SELECT count(*) FILTER (p IS NULL OR p < 0 OR p > 1) AS bad_scores, count(*) FILTER (y IS NULL) AS bad_labels, count(*) FILTER (markout IS NULL OR isnan(markout)) AS bad_markouts FROM v_scores"))
def input_checks(spark, sf):
    """Rows that an evaluation must not be given."""
    p, markout = F.col("p"), F.col("markout")
    return v.scores(spark, sf).agg(F.count_if(p.isNull() | ~p.between(0, 1)).alias("bad_scores"), F.count_if(F.col("y").isNull()).alias("bad_labels"), F.count_if(markout.isNull() | F.isnan(markout)).alias("bad_markouts"))


@query("q_V30_retry_pending", v.with_views(f"WITH {_RULED_SQL} SELECT user_id, arg_max(action, (ts_ms, event_id)) = 'alert' AS retry_pending FROM s GROUP BY user_id"))
def retry_pending(spark, sf):
    """Whether the latest verdict asks for another attempt; an aggregate, so no sort per key."""
    return ruled(spark, sf).groupBy("user_id").agg((F.max_by("action", F.struct("ts_ms", "event_id")) == "alert").alias("retry_pending"))
