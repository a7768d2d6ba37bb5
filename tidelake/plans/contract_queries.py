"""Event constraints, command-line specs, archive objects of contexts and fills, horizons, and replay depth, over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.functions import specs
from tidelake.operators import constraints, models
from tidelake.plans import adapters as v
from tidelake.plans.registry import query
from tidelake.session import new_folder
from tidelake.sources import archive_objects, venue_json

_CONSTRAINTS_SQL = v.with_views("""
WITH o AS (SELECT *, if(order_id % 41 = 0, 0, price) AS p, if(order_id % 29 = 0, 'abc', 'ABC') AS s, if(order_id % 31 = 0, NULL, side) AS d FROM v_orders),
u AS (
SELECT 'agg_trade' AS event_type, 'price is positive' AS "constraint", count(*) FILTER (p <= 0) AS n FROM o
UNION ALL SELECT 'agg_trade', 'symbol is in capitals', count(*) FILTER (s = 'abc') FROM o
UNION ALL SELECT 'agg_trade', 'quantity is positive', count(*) FILTER (quantity <= 0 OR quantity IS NULL) FROM o
UNION ALL SELECT 'agg_trade', 'ids are in order', count(*) FILTER (order_id % 37 = 0) FROM o
UNION ALL SELECT 'agg_trade', 'ids are not negative', count(*) FILTER (order_id = 0) FROM o
UNION ALL SELECT 'trade', 'side is known', count(*) FILTER (d IS NULL) FROM o
UNION ALL SELECT 'trade', 'quantity is positive', count(*) FILTER (quantity <= 0 OR quantity IS NULL) FROM o
UNION ALL SELECT 'hyperliquid_fill', 'maker side is signed', count(*) FILTER (tid % 43 = 0) FROM v_fills
UNION ALL SELECT 'hyperliquid_fill', 'fee is not negative', count(*) FILTER (tid % 47 = 0) FROM v_fills
UNION ALL SELECT 'hyperliquid_fill', 'quantity is positive', count(*) FILTER (sz <= 0 OR sz IS NULL) FROM v_fills
UNION ALL SELECT 'book_ticker', 'bid is below ask', count(*) FILTER (tie % 53 = 0) FROM v_book
UNION ALL SELECT 'book_depth', 'depth is not negative', count(*) FILTER (tie % 59 = 0) FROM v_book
UNION ALL SELECT 'kline', 'closes after it opens', count(*) FILTER (tie % 61 = 0) FROM v_bars
UNION ALL SELECT 'kline', 'high and low hold the others', count(*) FILTER (high < greatest(open, close) OR low > least(open, close)) FROM v_bars
UNION ALL SELECT 'agent_order', 'remaining is within quantity', count(*) FILTER (order_id % 67 = 0 OR quantity < 0 OR quantity IS NULL) FROM o
UNION ALL SELECT 'agent_order', 'quantity is positive', count(*) FILTER (quantity <= 0 OR quantity IS NULL) FROM o
UNION ALL SELECT 'agent_order', 'ids are not empty', count(*) FILTER (order_id % 71 = 0) FROM o)
SELECT * FROM u WHERE n > 0""")


def _typed(spark, sf) -> dict[str, DataFrame]:
    """Rows of all seven types from the driver's events, some of them broken."""
    orders, book = v.orders(spark, sf), v.book(spark, sf).selectExpr("*", "'ABC' AS symbol", "tie AS sequence")
    return {
        "agg_trade": orders.selectExpr("ts_ms", "sequence", "if(order_id % 29 = 0, 'abc', 'ABC') AS symbol", "if(order_id % 41 = 0, 0D, price) AS price", "quantity", "order_id AS aggregate_trade_id", "order_id AS first_trade_id", "order_id - if(order_id % 37 = 0, 1, 0) AS last_trade_id", "side = 'sell' AS is_buyer_maker"),
        "trade": orders.selectExpr("ts_ms", "sequence", "'ABC' AS symbol", "price", "quantity", "order_id AS trade_id", "if(order_id % 31 = 0, null, side) AS side"),
        "hyperliquid_fill": v.fills(spark, sf).selectExpr("ts_ms", "tid AS sequence", "'ABC' AS symbol", "px AS price", "sz AS quantity", "nullif(tid, 5) AS trade_id", "if(side = 'B', 'buy', 'sell') AS side", "if(tid % 43 = 0, 0, 1) AS maker_side", "if(tid % 47 = 0, -1D, fee) AS fee"),
        "book_ticker": book.selectExpr("ts_ms", "sequence", "symbol", "tie AS update_id", "bid_px AS bid_price", "if(tie % 53 = 0, bid_px, ask_px) AS ask_price", "bid_sz AS bid_quantity", "ask_sz AS ask_quantity"),
        "book_depth": book.selectExpr("ts_ms", "sequence", "symbol", "-1D AS percentage", "if(tie % 59 = 0, -1D, bid_sz) AS depth", "bid_px * bid_sz AS notional"),
        "kline": v.bars(spark, sf).selectExpr("ts_ms", "tie AS sequence", "'ABC' AS symbol", "'1m' AS interval", "open", "high", "low", "close", "ts_ms AS open_ts_ms", "ts_ms + if(tie % 61 = 0, -1, 59999) AS close_ts_ms", "abs(volume) AS volume", "trades AS trade_count"),
        "agent_order": orders.selectExpr("ts_ms", "sequence", "'ABC' AS symbol", "price", "quantity", "side", "action", "cast(scenario_id AS string) AS scenario_id", "if(order_id % 71 = 0, '', cast(agent_id AS string)) AS agent_id", "cast(order_id AS string) AS order_id", "if(order_id % 67 = 0, quantity + 1, quantity) AS remaining_quantity"),
    }


@query("q_P09_event_constraints", _CONSTRAINTS_SQL)
def event_constraints(spark, sf):
    return reduce(DataFrame.unionByName, (constraints.violations(rows, kind) for kind, rows in _typed(spark, sf).items()))


_SPECS_SQL = v.with_views("""
SELECT coin, strftime(unnest(generate_series(min(make_timestamp(ts_ms * 1000))::date, max(make_timestamp(ts_ms * 1000))::date, INTERVAL 1 DAY)), '%Y%m%d') AS day, count(*)::bigint % 24 AS last_hour, (1 + coin)::int AS n_thresholds
FROM v_bars GROUP BY coin""")


@query("q_P28_ranges", _SPECS_SQL)
def ranges(spark, sf):
    """Of each coin's bars the days as a range with a repeat, hours up to one, and a grid of thresholds, all written out and read."""
    bars = v.bars(spark, sf)
    text = lambda c: F.date_format(F.expr(f"date_add(DATE'1970-01-01', cast({c} div 86400000 as int))"), "yyyyMMdd")
    ends = bars.groupBy("coin").agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"), (F.count(F.lit(1)) % 24).alias("h"))
    given = ends.select("coin", F.concat_ws(",", F.concat(text("a"), F.lit(".."), text("b")), text("a")).alias("days"), F.concat(F.lit("0-"), "h").alias("hours"), F.concat(F.lit("0.1:"), F.round(0.1 + F.col("coin") * 0.05, 2), F.lit(":0.05")).alias("grid"))
    return given.select("coin", F.explode(specs.dates(F.col("days"))).alias("day"), F.array_max(specs.hours(F.col("hours"))).cast("long").alias("last_hour"), F.size(specs.thresholds(F.col("grid"))).alias("n_thresholds"))


@query("q_S15_context_objects", v.with_views("SELECT 'C' || coin AS coin, ts_ms, round(funding, 9) AS funding, open_interest, oracle_px, mark_px, mark_px AS mid_px, 0.0::double AS premium FROM v_ctx"))
def context_objects(spark, sf):
    """Contexts written as CSV objects of both header styles, and read back: S12 over a codec scan."""
    rows, root = v.contexts(spark, sf), new_folder(spark)
    styles = {0: "time,coin,funding,openInterest,oraclePx,markPx", 1: "time,coin,funding,open_interest,oracle_px,mark_px,mid_px,premium"}
    value = F.concat_ws(",", "ts_ms", F.concat(F.lit("C"), "coin"), "funding", "open_interest", "oracle_px", "mark_px")
    lines = rows.select(F.format_string("style%d/%d.csv.lz4", F.col("coin").cast("int") % 2, F.expr("cast(ts_ms div 86400000 as int)")).alias("object"), F.col("tie").alias("line_no"), F.when(F.col("coin") % 2 == 1, F.concat(value, F.lit(",,"))).otherwise(value).alias("value"))
    header = F.when(F.col("object").startswith("style1"), styles[1]).otherwise(styles[0])
    heads = lines.select("object").distinct().select("object", F.lit(-1).cast("long").alias("line_no"), header.alias("value"))
    archive_objects.write_objects(heads.unionByName(lines), root).write.format("noop").mode("overwrite").save()
    return archive_objects.load_contexts(spark, root).select("coin", "ts_ms", F.round("funding", 9).alias("funding"), "open_interest", "oracle_px", "mark_px", "mid_px", "premium")


@query("q_S19_fill_objects", v.with_views("SELECT 'C' || coin AS coin, ts_ms, px, sz, side, tid FROM v_fills"))
def fill_objects(spark, sf):
    """Fills written as objects of nested JSON, one for each coin, and read back."""
    root = new_folder(spark)
    fill = F.struct(F.concat(F.lit("C"), "coin").alias("coin"), F.col("px").cast("string").alias("px"), F.col("sz").cast("string").alias("sz"), "side", F.col("ts_ms").alias("time"), "tid")
    lines = v.fills(spark, sf).select(F.format_string("node_fills/%d.lz4", F.col("coin").cast("int")).alias("object"), F.col("tid").alias("line_no"), F.to_json(F.struct(F.array(F.struct(fill.alias("fill"))).alias("events"))).alias("value"))
    archive_objects.write_objects(lines, root).write.format("noop").mode("overwrite").save()
    return venue_json.typed_fills(archive_objects.load_fills(spark, root)).select("coin", "ts_ms", "px", "sz", "side", "tid")


@query("q_S17_json_or_lines", v.with_views("SELECT event_id FROM ev WHERE event_type = 'purchase'"))
def json_or_lines(spark, sf):
    """Half of the days' events as one document each over several lines, half as a document a line; all events are found."""
    rows = v.events(spark, sf).filter("event_type = 'purchase'").withColumn("day", F.expr("ts_ms div 86400000"))
    document = F.to_json(F.struct("event_id"))
    by_line = rows.groupBy("user_id", "day").agg(F.array_join(F.sort_array(F.collect_list(document)), "\n").alias("value")).filter("day % 2 = 0")
    whole = rows.filter("day % 2 = 1").select(F.concat(F.lit('{\n"event_id": '), "event_id", F.lit("\n}")).alias("value"))
    found = venue_json.json_or_lines(by_line.select("value").unionByName(whole))
    return found.select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"))


@query("q_K08_horizons", v.with_views("""
WITH h AS (SELECT tid, unnest([1, 6, 24]) AS h, px, ts_ms, coin, CASE WHEN coalesce(crossed, false) THEN -1 ELSE 1 END * CASE side WHEN 'B' THEN 1 ELSE -1 END AS s FROM v_fills),
j AS (SELECT h.*, (b.bid_px + b.ask_px) / 2 AS mid FROM h ASOF JOIN v_book b ON h.coin = b.coin AND h.ts_ms + h.h * 3600000 <= b.ts_ms)
SELECT tid, round(max(s * (mid - px) / px * 10000) FILTER (h = 1), 6) + 0 AS markout_bps_1h, round(max(s * (mid - px) / px * 10000) FILTER (h = 6), 6) + 0 AS markout_bps_6h, round(max(s * (mid - px) / px * 10000) FILTER (h = 24), 6) + 0 AS markout_bps_24h FROM j GROUP BY tid"""))
def horizons(spark, sf):
    """The markout of each horizon as a map of the fill, flattened to columns; a horizon without a later quote is empty."""
    from tidelake.functions import market
    from tidelake.operators import temporal

    fills = v.fills(spark, sf).withColumn("maker_side", market.maker_side())
    found = None
    for h in (1, 6, 24):
        rows = temporal.asof_forward(fills, v.book(spark, sf, v.IN_TIME), "coin", "b_", h * v.HOUR)
        mid = market.mid("b_bid_px", "b_ask_px")
        one = rows.select("tid", F.lit(f"{h}h").alias("h"), (F.col("maker_side") * (mid - F.col("px")) / F.col("px") * 10000).alias("bps"))
        found = one if found is None else found.unionByName(one)
    maps = found.groupBy("tid").agg(F.map_from_entries(F.collect_list(F.struct("h", "bps"))).alias("markout"))
    return maps.select("tid", *[(F.round(F.col("markout")[f"{h}h"], 6) + 0).alias(f"markout_bps_{h}h") for h in (1, 6, 24)])


@query("q_K11_replay_depth", v.with_views("""
WITH d AS (SELECT * FROM v_book WHERE ts_ms // 86400000 = (SELECT max(ts_ms // 86400000) FROM v_book)), m AS (SELECT *, (bid_px + ask_px) / 2 AS mid FROM d)
SELECT tie, round(-abs((bid_px / mid - 1) * 100), 6) AS percentage, bid_sz AS depth, bid_px * bid_sz AS notional FROM m
UNION ALL SELECT tie, round(abs((ask_px / mid - 1) * 100), 6), ask_sz, ask_px * ask_sz FROM m"""))
def replay_depth(spark, sf):
    """The newest day's book as depth rows: each level by its signed distance from mid in per cent."""
    from tidelake.functions import market

    book = v.book(spark, sf).withColumn("day", F.expr("ts_ms div 86400000"))
    newest = book.agg(F.max("day").alias("day"))
    rows = book.join(F.broadcast(newest), "day").withColumn("mid", market.mid("bid_px", "ask_px"))
    level = lambda px, sz, side: F.struct((side * F.abs((F.col(px) / F.col("mid") - 1) * 100)).alias("percentage"), F.col(sz).alias("depth"), (F.col(px) * F.col(sz)).alias("notional"))
    each = rows.select("tie", F.explode(F.array(level("bid_px", "bid_sz", -1), level("ask_px", "ask_sz", 1))).alias("l"))
    return each.select("tie", F.round("l.percentage", 6).alias("percentage"), "l.depth", "l.notional")


@query("q_M01_isotonic_fit", v.with_views("""
WITH c AS (SELECT p, count(*) AS n, sum(y::int) AS t, row_number() OVER (ORDER BY p) AS i FROM v_scores GROUP BY p),
s AS (SELECT *, sum(n) OVER (ORDER BY i) AS cn, sum(t) OVER (ORDER BY i) AS ct FROM c),
m AS (SELECT a.i AS ai, b.i AS bi, (b.ct - a.ct + a.t) / (b.cn - a.cn + a.n) AS mean FROM s a JOIN s b ON b.i >= a.i),
g AS (SELECT ai, bi, min(mean) OVER (PARTITION BY ai ORDER BY bi DESC) AS least FROM m)
SELECT s.p, round(max(g.least), 9) AS fit FROM s JOIN g ON g.bi = s.i GROUP BY s.p"""))
def isotonic_fit(spark, sf):
    """The calibrated value of every score, by blocks; SQL takes the largest of the least means from every start."""
    rows = v.scores(spark, sf)
    blocks = models.isotonic_blocks(rows, "p", "y", parts=5).select("lo", "hi", (F.col("total") / F.col("n")).alias("rate"))
    scores = rows.select("p").distinct()
    return scores.join(blocks, (F.col("p") >= F.col("lo")) & (F.col("p") <= F.col("hi"))).select("p", F.round("rate", 9).alias("fit"))
