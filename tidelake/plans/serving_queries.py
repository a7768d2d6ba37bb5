"""Serving queries: counts, latest rows, upserts, set operations, lookups, replay ticks, sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelake.functions import market
from tidelake.operators import ordered, policy, replay, tables, temporal
from tidelake.plans import adapters as v
from tidelake.plans.policy_queries import _RULED_SQL, ruled
from tidelake.plans.registry import query
from tidelake.session import table


@query("q_A36_source_coverage", v.with_views("SELECT coin, side, count(*) AS n, max(ts_ms) AS latest, sum(CASE WHEN crossed THEN 1 ELSE 0 END)::bigint AS crossed FROM v_fills GROUP BY coin, side"))
def source_coverage(spark, sf):
    return v.fills(spark, sf).groupBy("coin", "side").agg(F.count(F.lit(1)).alias("n"), F.max("ts_ms").alias("latest"), F.sum(F.when(F.col("crossed"), 1).otherwise(0)).alias("crossed"))


@query("q_A36_source_rollup", v.with_views("SELECT coin, side, count(*) AS n FROM v_fills GROUP BY ROLLUP (coin, side)"))
def source_rollup(spark, sf):
    return v.fills(spark, sf).rollup("coin", "side").agg(F.count(F.lit(1)).alias("n"))


@query("q_A38_alert_breakdown", v.with_views(f"WITH {_RULED_SQL} SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity IN ('critical', 'high')) AS elevated, count(*) - count(*) FILTER (severity IN ('critical', 'high', 'medium')) AS informational, count(DISTINCT user_id) AS agents FROM s"))
def alert_breakdown(spark, sf):
    s = F.col("severity")
    return ruled(spark, sf).agg(F.count_if(s == "critical").alias("critical"), F.count_if(s.isin("critical", "high")).alias("elevated"), (F.count(F.lit(1)) - F.count_if(s.isin("critical", "high", "medium"))).alias("informational"), F.count_distinct("user_id").alias("agents"))


@query("q_A41_chart_scale", v.with_views("SELECT coin, min(low) AS lo, max(high) AS hi, max(volume) AS max_volume FROM v_bars GROUP BY coin"))
def chart_scale(spark, sf):
    return v.bars(spark, sf).groupBy("coin").agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.max("volume").alias("max_volume"))


@query("q_J09_label_lookup", "SELECT d.doc_id, l.quality = 1 AS good, l.toxic = 1 AS toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def label_lookup(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))


@query("q_J10_alert_fallback", v.with_views(f"WITH {_RULED_SQL} SELECT s.event_id, coalesce(f.px, 0) AS px, CASE WHEN f.tid IS NULL THEN 'alert' ELSE 'tick' END AS evidence FROM s LEFT JOIN v_fills f ON f.tid = s.event_id WHERE s.action <> 'allow'"))
def alert_fallback(spark, sf):
    """Alerts with their tick; where there is none, the case is built from the alert."""
    fills = v.fills(spark, sf).select(F.col("tid").alias("event_id"), "px")
    rows = ruled(spark, sf).filter("action <> 'allow'").join(fills, "event_id", "left")
    return rows.select("event_id", F.coalesce("px", F.lit(0.0)).alias("px"), F.when(F.col("px").isNull(), "alert").otherwise("tick").alias("evidence"))


@query("q_J11_decision_by_alert", v.with_views("SELECT f.tid, f.coin FROM (SELECT 'alert_' || event_id AS alert_id FROM ev) a JOIN v_fills f ON f.tid = regexp_replace(a.alert_id, '^alert_', '')::bigint"))
def decision_by_alert(spark, sf):
    alerts = v.events(spark, sf).select(F.concat(F.lit("alert_"), "event_id").alias("alert_id"))
    return alerts.withColumn("tid", F.regexp_replace("alert_id", "^alert_", "").cast("long")).join(v.fills(spark, sf), "tid").select("tid", "coin")


@query("q_J12_open_cases", v.with_views(f"WITH {_RULED_SQL} SELECT count(*) FILTER (event_id NOT IN (SELECT tid FROM v_fills)) AS open, count(*) FILTER (event_id IN (SELECT tid FROM v_fills)) AS in_review FROM s WHERE action <> 'allow'"))
def open_cases(spark, sf):
    alerts, decided = ruled(spark, sf).filter("action <> 'allow'"), v.fills(spark, sf).select(F.col("tid").alias("event_id"))
    open_, review = alerts.join(decided, "event_id", "left_anti"), alerts.join(decided, "event_id", "left_semi")
    return open_.agg(F.count(F.lit(1)).alias("open")).join(F.broadcast(review.agg(F.count(F.lit(1)).alias("in_review"))))  # one row each


@query("q_J14_parent_with_children", "SELECT n_name, count(s_suppkey) AS n_suppliers, coalesce(list_sum(list(s_suppkey) FILTER (s_suppkey IS NOT NULL)), 0)::bigint AS id_sum FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def parent_with_children(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.collect_list("s_suppkey").alias("children"))
    return rows.select("n_name", F.size("children").cast("long").alias("n_suppliers"), F.aggregate("children", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


@query("q_J15_aligned_days", v.with_views("WITH a AS (SELECT DISTINCT coin, ts_ms // 86400000 AS day FROM v_bars), b AS (SELECT DISTINCT coin, ts_ms // 86400000 AS day FROM v_ctx) SELECT a.coin, count(b.day) AS n_aligned, coalesce(max(b.day), max(a.day)) AS latest FROM a LEFT JOIN b USING (coin, day) GROUP BY a.coin"))
def aligned_days(spark, sf):
    """Of each coin the days with bars and contexts, and the latest of them; the latest with bars, if none has both."""
    days = lambda df: df.select("coin", F.expr("ts_ms div 86400000").alias("day")).distinct()
    both = days(v.bars(spark, sf)).join(days(v.contexts(spark, sf)).withColumn("there", F.lit(True)), ["coin", "day"], "left")
    aligned = F.when(F.col("there"), F.col("day"))
    return both.groupBy("coin").agg(F.count(aligned).alias("n_aligned"), F.coalesce(F.max(aligned), F.max("day")).alias("latest"))


@query("q_T01_total_order", v.with_views("SELECT order_id, row_number() OVER (ORDER BY ts_ms, sequence) AS place FROM v_orders"))
def total_order(spark, sf):
    """Every order's place in time; none of the parts that are numbered holds the table."""
    return ordered.running(v.orders(spark, sf), "ts_ms", {"place": F.lit(1).cast("long")}, tie=["sequence"]).select("order_id", "place")


@query("q_T02_latest_n", v.with_views("SELECT tid, px FROM v_fills ORDER BY ts_ms DESC, tid DESC LIMIT 100"))
def latest_n(spark, sf):
    return tables.latest(v.fills(spark, sf), 500, F.desc("ts_ms"), F.desc("tid")).select("tid", "px")


@query("q_T04_top_features", "WITH m AS (SELECT vec_id, list_transform(range(1, len(embedding) + 1), lambda i: struct_pack(k := 'f' || i, a := embedding[i]::double)) AS l FROM embeddings) SELECT vec_id, array_to_string(list_transform(list_slice(list_sort(list_transform(l, lambda x: struct_pack(o := -abs(x.a), k := x.k))), 1, 3), lambda x: x.k), ',') AS top FROM m")
def top_features(spark, sf):
    named = F.transform("embedding", lambda x, i: F.struct(F.concat(F.lit("f"), i + 1).alias("key"), x.cast("double").alias("value")))
    rows = table(spark, sf, "embeddings").select("vec_id", F.map_from_entries(named).alias("m"))
    return rows.select("vec_id", F.array_join(F.transform(tables.top_entries("m", 3), lambda e: e["key"]), ",").alias("top"))


@query("q_T07_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")
def page(spark, sf):
    return tables.page(table(spark, sf, "orders"), 2, F.col("o_orderkey")).select("o_orderkey", "o_totalprice")


@query("q_T08_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_type), 'steel') ORDER BY p_partkey")
def search(spark, sf):
    return table(spark, sf, "part").filter(F.lower(F.concat_ws(" ", "p_name", "p_type")).contains("steel")).select("p_partkey", "p_name")


@query("q_T09_leaderboard", v.with_views("WITH m AS (SELECT scenario, round(avg((p - y::int) ** 2), 9) AS brier, count(*) AS n FROM v_scores GROUP BY scenario) SELECT scenario, brier, n, row_number() OVER (ORDER BY brier, scenario) AS place FROM m"))
def leaderboard(spark, sf):
    runs = v.scores(spark, sf).groupBy("scenario").agg(F.round(F.avg(F.pow(F.col("p") - F.col("y").cast("double"), 2)), 9).alias("brier"), F.count(F.lit(1)).alias("n"))
    return runs.withColumn("place", F.row_number().over(Window.orderBy("brier", "scenario")).cast("long"))


@query("q_U01_event_union", v.with_views("SELECT kind, count(*) AS n, count(bid_px) AS with_bid, count(px) AS with_px FROM (SELECT 'quote' AS kind, bid_px, NULL::double AS px FROM v_book UNION ALL SELECT 'fill', NULL, px FROM v_fills) GROUP BY kind"))
def event_union(spark, sf):
    both = v.book(spark, sf).withColumn("kind", F.lit("quote")).unionByName(v.fills(spark, sf).withColumn("kind", F.lit("fill")), allowMissingColumns=True)
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("bid_px").alias("with_bid"), F.count("px").alias("with_px"))


@query("q_U03_key_sets", v.with_views("WITH a AS (SELECT DISTINCT user_id AS u FROM ev WHERE event_type = 'error'), b AS (SELECT DISTINCT user_id AS u FROM ev WHERE event_type = 'signup') SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS n_both, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS n_only_a, (SELECT count(*) FROM (FROM a UNION FROM b)) AS n_any"))
def key_sets(spark, sf):
    users = lambda kind: v.events(spark, sf).filter(F.col("event_type") == kind).select("user_id").distinct()
    a, b = users("error").withColumn("a", F.lit(True)), users("signup").withColumn("b", F.lit(True))
    has_a, has_b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return a.join(b, "user_id", "full").agg(F.count_if(has_a & has_b).alias("n_both"), F.count_if(has_a & ~has_b).alias("n_only_a"), F.count(F.lit(1)).alias("n_any"))


@query("q_K08_markout_flatten", v.with_views("SELECT user_id, max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'error') AS error FROM ev GROUP BY user_id"))
def markout_flatten(spark, sf):
    """A map per key, flattened to fixed columns."""
    maps = v.events(spark, sf).groupBy("user_id", "event_type").agg(F.max("value").alias("x")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "x"))).alias("m"))
    return maps.select("user_id", *[F.col("m")[k].alias(k) for k in ("view", "click", "error")])


@query("q_K13_coverage", v.with_views("WITH r AS (SELECT min(ts_ms // 86400000) - 1 AS a, max(ts_ms // 86400000) + 1 AS b FROM v_bars), g AS (SELECT coin, unnest(generate_series(a, b)) AS day FROM (SELECT DISTINCT coin FROM v_bars), r), p AS (SELECT DISTINCT coin, ts_ms // 86400000 AS day FROM v_bars) SELECT g.coin, count(*) AS expected, count(p.day) AS present, array_to_string(list_sort(coalesce(list(g.day) FILTER (p.day IS NULL), [])), ',') AS missing, round(count(p.day) / count(*), 9) AS ratio FROM g LEFT JOIN p ON p.coin = g.coin AND p.day = g.day GROUP BY g.coin"))
def coverage(spark, sf):
    """Per coin the grid of days against those present."""
    bars = v.bars(spark, sf)
    day = F.expr("ts_ms div 86400000")
    span = bars.agg((F.min(day) - 1).alias("a"), (F.max(day) + 1).alias("b"))  # a day more at either end, to be missing
    grid = bars.select("coin").distinct().join(F.broadcast(span)).select("coin", F.explode(F.sequence("a", "b")).alias("day"))
    present = bars.select("coin", F.expr("ts_ms div 86400000").alias("day")).distinct().withColumn("there", F.lit(1))
    n, there = F.count(F.lit(1)), F.count("there")
    missing = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("there").isNull(), F.col("day")))), lambda d: d.cast("string")), ",")
    return grid.join(present, ["coin", "day"], "left").groupBy("coin").agg(n.alias("expected"), there.alias("present"), missing.alias("missing"), F.round(there / n, 9).alias("ratio"))


@query("q_K17_upsert", v.with_views("SELECT agent_id, arg_max(order_id, (ts_ms, order_id)) AS order_id, arg_max(action, (ts_ms, order_id)) AS action FROM v_orders GROUP BY agent_id"))
def upsert(spark, sf):
    rows = v.orders(spark, sf)
    return tables.upsert(rows.filter("order_id % 2 = 0"), rows.filter("order_id % 2 = 1"), ["agent_id"], F.struct("ts_ms", "order_id")).select("agent_id", "order_id", "action")


@query("q_K12_manifest_hash", "SELECT sha256(string_agg(n_nationkey || '|' || n_name, chr(10) ORDER BY n_nationkey)) AS hash FROM nation")
def manifest_hash(spark, sf):
    return tables.content_hash(table(spark, sf, "nation"), ["n_nationkey"], ["n_nationkey", "n_name"])


@query("q_K05_silver_top_of_book", v.with_views("SELECT coin, count(*) AS n, round(avg((bid_px + ask_px) / 2), 6) AS avg_mid, round(avg((ask_px - bid_px) / ((bid_px + ask_px) / 2) * 10000), 6) AS avg_spread_bps FROM v_book GROUP BY coin"))
def silver_top_of_book(spark, sf):
    return v.book(spark, sf).groupBy("coin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(market.mid()), 6).alias("avg_mid"), F.round(F.avg(market.spread_bps()), 6).alias("avg_spread_bps"))


@query("q_K11_replay_seed", v.with_views("SELECT coin, ts_ms, close FROM v_bars b WHERE ts_ms // 86400000 = (SELECT max(ts_ms // 86400000) FROM v_bars) QUALIFY row_number() OVER (ORDER BY ts_ms DESC, tie DESC) <= 20"))
def replay_seed(spark, sf):
    """The newest day's last bars."""
    bars = v.bars(spark, sf).withColumn("day", F.expr("ts_ms div 86400000"))
    newest = bars.agg(F.max("day").alias("day"))
    return bars.join(F.broadcast(newest), "day").orderBy(F.desc("ts_ms"), F.desc("tie")).limit(20).select("coin", "ts_ms", "close")


@query("q_P10_quote_from_ladder", v.with_views("WITH l AS (SELECT user_id AS snap, k - 50 AS percentage FROM ev WHERE event_type = 'click'), q AS (SELECT snap, coalesce(max(percentage) FILTER (percentage < 0), -1)::double AS b, coalesce(min(percentage) FILTER (percentage > 0), 1)::double AS a FROM l GROUP BY snap) SELECT snap, round(100 * (1 + b / 100), 6) AS bid, round(100 * (1 + a / 100), 6) AS ask FROM q"))
def quote_from_ladder(spark, sf):
    depth = v.events(spark, sf).filter("event_type = 'click'").selectExpr("user_id AS snap", "double(k - 50) AS percentage", "value AS depth", "value AS notional")
    bid, ask = replay.derived_quote(F.lit(100.0), F.col("levels"))
    return replay.ladder(depth, ["snap"]).select("snap", F.round(bid, 6).alias("bid"), F.round(ask, 6).alias("ask"))


def _templates_sql() -> str:
    """The scenarios with rules, action and score, worked out by DuckDB from their features."""
    names = ["scenario", *policy.FEATURES, "side_rule", "order_offset", "order_qty", "trade_qty", "trade_offset"]
    values = ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else f"{x}::double" for x in t) + ")" for t in replay.TEMPLATES)
    rules = " + ".join(f"({p})::int" for _, p in policy.RULES)
    acted = f"SELECT *, {rules} AS n_rules FROM (VALUES {values}) t({', '.join(names)})"
    return f"tpl AS (SELECT *, CASE WHEN n_rules >= 2 THEN 'block' WHEN n_rules = 1 THEN 'alert' ELSE 'allow' END AS action FROM ({acted}))"


@query("q_M14_replay_ticks", v.with_views(f"""WITH {_templates_sql()}, b AS (SELECT *, row_number() OVER (PARTITION BY coin ORDER BY ts_ms, tie) - 1 AS idx FROM v_bars),
q AS (SELECT b.tie, arg_min(d.bid_px, (abs(d.ts_ms - b.ts_ms), -d.ts_ms, CASE WHEN d.ts_ms > b.ts_ms THEN d.tie ELSE -d.tie END)) AS bid FROM b JOIN v_book d ON d.coin = b.coin GROUP BY b.tie)
SELECT tie, scenario, CASE WHEN side_rule = 'EVEN' THEN CASE WHEN idx % 2 = 0 THEN 'BUY' ELSE 'SELL' END ELSE side_rule END AS tick_side, round(close + order_offset, 6) AS order_px, round(close + trade_offset, 6) AS trade_px, bid AS depth_bid, action, CASE action WHEN 'block' THEN 0.88 WHEN 'alert' THEN 0.58 ELSE 0.15 END::double AS risk_score FROM b JOIN q USING (tie), tpl"""))
def replay_ticks(spark, sf):
    """Every bar in every scenario: the nearest depth, the scenario's order and trade around the close, rules, action, score."""
    bars = temporal.asof_nearest(v.bars(spark, sf), v.book(spark, sf).select("coin", "ts_ms", "bid_px", "tie"), "coin", "depth_")
    rows = replay.ticks(bars, None, ["ts_ms", "tie"])
    return rows.select("tie", "scenario", "tick_side", F.round("order_px", 6).alias("order_px"), F.round("trade_px", 6).alias("trade_px"), F.col("depth_bid_px").alias("depth_bid"), "action", "risk_score")


@query("q_M13_templates", v.with_views(f"WITH {_templates_sql()} SELECT scenario, coin, action, n_rules, count(*) AS n FROM tpl, v_bars GROUP BY ALL"))
def scenario_templates(spark, sf):
    """Each scenario replayed over each coin's bars: what its rules say, and how often."""
    rows = replay.ticks(v.bars(spark, sf), None, ["ts_ms", "tie"])
    return rows.groupBy("scenario", "coin", "action", F.size("matched_rules").alias("n_rules")).agg(F.count(F.lit(1)).alias("n"))


@query("q_M06_padded_sequences", "WITH t AS (SELECT role, dense_rank() OVER (ORDER BY role) AS token FROM (SELECT DISTINCT role FROM conversations)), s AS (SELECT conv_id, list(token ORDER BY turn, token) AS l FROM conversations JOIN t USING (role) GROUP BY conv_id) SELECT conv_id, array_to_string(list_transform(range(1, 9), lambda i: coalesce(l[i], 0)), ',') AS tokens, least(len(l), 8)::int AS n FROM s")
def padded_sequences(spark, sf):
    rows = table(spark, sf, "conversations")
    coded = rows.join(tables.vocabulary(rows, "role"), "role")
    return tables.padded_sequences(coded, "conv_id", "turn", "token", 8).select("conv_id", F.array_join(F.transform("tokens", lambda x: x.cast("string")), ",").alias("tokens"), "n")


@query("q_W11_event_gaps", v.with_views("SELECT order_id, round(ln(1 + greatest(coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY scenario_id ORDER BY ts_ms, sequence), 0), 0)), 6) AS log_gap FROM v_orders"))
def event_gaps(spark, sf):
    rows = temporal.with_previous(v.orders(spark, sf), "scenario_id", ["ts_ms"], "sequence")
    gap = F.col("ts_ms") - F.col("_previous.ts_ms")
    return rows.select("order_id", F.round(F.log1p(F.greatest(F.coalesce(gap, F.lit(0)), F.lit(0))), 6).alias("log_gap"))


@query("q_W14_risk_direction", v.with_views("SELECT doc_id, CASE WHEN p > q THEN 'up' WHEN p < q THEN 'down' ELSE 'flat' END AS direction FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY scenario ORDER BY ts_ms) AS q FROM v_scores)"))
def risk_direction(spark, sf):
    rows = temporal.with_previous(v.scores(spark, sf), "scenario", ["p"], "doc_id").withColumn("q", F.col("_previous.p"))
    return rows.select("doc_id", F.when(F.col("p") > F.col("q"), "up").when(F.col("p") < F.col("q"), "down").otherwise("flat").alias("direction"))


@query("q_P05_training_frame", v.with_views("SELECT count(*) AS n, count(*) FILTER (b IS NULL OR isnan(b) OR isinf(b)) AS dropped FROM (SELECT CASE WHEN event_id % 7 = 0 THEN 'nan'::double WHEN event_id % 11 = 0 THEN 'infinity'::double WHEN event_id % 13 = 0 THEN NULL ELSE value END AS b FROM ev)"))
def training_frame(spark, sf):
    """Values that aren't finite numbers become null, and incomplete rows are dropped."""
    text = F.when(F.col("event_id") % 7 == 0, "NaN").when(F.col("event_id") % 11 == 0, "Infinity").when(F.col("event_id") % 13 == 0, None).otherwise(F.col("value").cast("string"))
    number = F.expr("try_cast(x AS double)")
    finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    return v.events(spark, sf).withColumn("x", text).select(finite.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("b").isNull()).alias("dropped"))


@query("q_P25_drift_severity", v.with_views("SELECT doc_id, CASE WHEN p >= 0.25 THEN 'significant' WHEN p >= 0.1 THEN 'moderate' ELSE 'none' END AS severity FROM v_scores"))
def drift_severity(spark, sf):
    return v.scores(spark, sf).select("doc_id", policy.drift_severity(F.col("p")).alias("severity"))


@query("q_P31_demo_ticks", "SELECT event_id AS i, round(100 + 5 * sin(event_id / 10), 6) AS price, round(least(greatest(0.5 + 0.4 * sin(event_id / 7), 0), 1), 6) AS risk FROM events")
def demo_ticks(spark, sf):
    """The demo's wave at the place of every event."""
    i = F.col("i")
    risk = F.least(F.greatest(0.5 + 0.4 * F.sin(i / 7), F.lit(0.0)), F.lit(1.0))
    return v.events(spark, sf).select(F.col("event_id").alias("i")).select("i", F.round(100 + 5 * F.sin(i / 10), 6).alias("price"), F.round(risk, 6).alias("risk"))


_PATHS_SQL = v.with_views("""WITH d AS (SELECT DISTINCT make_timestamp(ts_ms * 1000)::date AS day FROM v_bars)
SELECT day, 'data/futures/um/daily/klines/BTCUSDT/1m/BTCUSDT-1m-' || strftime(day, '%Y-%m-%d') || '.zip' AS path FROM d""")


@query("q_S08_archive_paths", _PATHS_SQL)
def archive_paths(spark, sf):
    """Where the archive keeps the days that have bars."""
    from tidelake.sources import exchange_csv

    days = v.bars(spark, sf).select(F.expr("date_add(DATE'1970-01-01', cast(ts_ms div 86400000 as int))").alias("day")).distinct()
    return exchange_csv.archive_paths(days, "klines", "btcusdt", "1m")


@query("q_S18_fill_coercion", v.with_views("SELECT event_id, CASE k % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'A' END AS side, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS crossed FROM ev"))
def fill_coercion(spark, sf):
    from tidelake.sources import venue_json

    e = v.events(spark, sf)
    side, crossed = F.expr("element_at(array(' buy', 'ASK', 'bid', 'sell'), k % 4 + 1)"), F.expr("element_at(array('Yes', '0', ''), k % 3 + 1)")
    empty = {n: F.lit(None).cast("string") for n in ("coin", "px", "sz", "hash", "fee", "feeToken", "builderFee", "dir", "raw_json")} | {"time": F.lit(0).cast("long"), "tid": F.lit(0).cast("long")}
    return venue_json.typed_fills(e.select(F.col("event_id").alias("oid"), side.alias("side"), crossed.alias("crossed"), *[c.alias(n) for n, c in empty.items()])).select(F.col("oid").alias("event_id"), "side", "crossed")


@query("q_S27_depth_ladders", v.with_views("SELECT user_id AS snap, count(*) AS n, arg_min(value, (k, event_id)) AS first_depth FROM ev WHERE event_type = 'click' GROUP BY user_id"))
def depth_ladders(spark, sf):
    depth = v.events(spark, sf).filter("event_type = 'click'").selectExpr("user_id AS snap", "k + event_id / 1e9D AS percentage", "value AS depth", "value AS notional")
    return replay.ladder(depth, ["snap"]).select("snap", F.size("levels").cast("long").alias("n"), F.col("levels")[0]["depth"].alias("first_depth"))
