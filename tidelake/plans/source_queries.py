"""Readers and writers on what the driver's tables would look like in the archives' formats, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.operators import lake
from tidelake.plans import adapters as v
from tidelake.plans.registry import query
from tidelake.session import new_folder
from tidelake.sources import exchange_csv, venue_json

#: Files of the stand-in archive: one per coin, a header before the first row.
_PLACED = "row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) - 1"


def _lines(spark, sf, header: str, value: str):
    """Each event as a line of its coin's file, after a header and a blank line."""
    rows = v.events(spark, sf).selectExpr("cast(user_id % 5 AS string) AS file", "event_id AS line_no", f"{value} AS value")
    heads = rows.select("file").distinct().select("file", F.posexplode(F.array(F.lit(header), F.lit(" "))).alias("i", "value")).selectExpr("file", "i - 2L AS line_no", "value")
    return exchange_csv.data_rows(rows.unionByName(heads))


@query("q_S02_agg_trades", v.with_views(f"SELECT 'BTCUSDT' AS symbol, event_id AS agg_trade_id, k / 4e0 AS price, 1 + k % 5 / 2e0 AS quantity, event_id AS first_trade_id, event_id + k % 3 AS last_trade_id, ts_ms, event_id % 2 = 0 AS is_buyer_maker, {_PLACED} AS sequence FROM ev"))
def agg_trades(spark, sf):
    rows = _lines(spark, sf, "id,price,quantity", "concat_ws(',', event_id, k / 4D, 1 + k % 5 / 2D, event_id, event_id + k % 3, ts_ms, if(event_id % 2 = 0, 'True', 'false'))")
    return exchange_csv.parse(rows, "aggTrades", "btcusdt").withColumn("ts_ms", F.unix_millis("timestamp")).drop("timestamp")


@query("q_S03_trades", v.with_views(f"SELECT event_id AS trade_id, k / 4e0 AS price, CASE WHEN event_id % 3 = 0 THEN 'sell' ELSE 'buy' END AS side, ts_ms, {_PLACED} AS sequence FROM ev"))
def trades(spark, sf):
    rows = _lines(spark, sf, "id,price", "concat_ws(',', event_id, k / 4D, 1, 1, ts_ms, event_id % 3 = 0)")
    return exchange_csv.parse(rows, "trades", "x").select("trade_id", "price", "side", F.unix_millis("timestamp").alias("ts_ms"), "sequence")


@query("q_S04_book_ticker", v.with_views(f"SELECT ts_ms, k / 4e0 AS bid_px, 1e0 AS bid_sz, k / 4e0 + 1 AS ask_px, 2e0 AS ask_sz, {_PLACED} AS sequence FROM ev"))
def book_ticker(spark, sf):
    """The time stands in the sixth column, or in the first where that is empty."""
    rows = _lines(spark, sf, "timestamp,bid", "concat_ws(',', if(event_id % 2 = 0, 7, ts_ms), k / 4D, 1, k / 4D + 1, 2, if(event_id % 2 = 0, cast(ts_ms AS string), ''))")
    return exchange_csv.parse(rows, "bookTicker", "x").select(F.unix_millis("timestamp").alias("ts_ms"), "bid_px", "bid_sz", "ask_px", "ask_sz", "sequence")


@query("q_S05_book_depth", v.with_views("SELECT ts_ms // 1000 * 1000 AS ts_ms, k - 50e0 AS percentage, value AS depth, count(*) AS n FROM ev GROUP BY ALL"))
def book_depth(spark, sf):
    """Times are text in UTC, to the second."""
    rows = _lines(spark, sf, "timestamp,percentage", "concat_ws(',', date_format(timestamp_seconds(ts_ms div 1000), 'yyyy-MM-dd HH:mm:ss'), k - 50D, value, value)")
    parsed = exchange_csv.parse(rows, "bookDepth", "x")
    return parsed.groupBy(F.unix_millis("timestamp").alias("ts_ms"), "percentage", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("q_S06_klines", v.with_views(f"SELECT ts_ms AS open_ms, ts_ms + 59999 AS ts_ms, k * 1e0 AS open, k + 2e0 AS high, k - 1e0 AS low, k + 1e0 AS close, value AS volume, k::bigint AS trade_count, {_PLACED} AS sequence FROM ev"))
def klines(spark, sf):
    rows = _lines(spark, sf, "open_time,open", "concat_ws(',', ts_ms, k, k + 2, k - 1, k + 1, value, ts_ms + 59999, 0, k, 0, 0, 0)")
    return exchange_csv.parse(rows, "klines", "x", "1m").select(F.unix_millis("open_time").alias("open_ms"), F.unix_millis("timestamp").alias("ts_ms"), "open", "high", "low", "close", "volume", "trade_count", "sequence")


@query("q_S09_archive_keys", v.with_views("SELECT DISTINCT 'C' || (user_id % 5) AS coin, ts::date AS date, hour(ts)::int AS hour, 'market_data/' || strftime(ts, '%Y%m%d') || '/' || hour(ts) || '/l2Book/C' || (user_id % 5) || '.lz4' AS book_key, 'asset_ctxs/' || strftime(ts, '%Y%m%d') || '.csv.lz4' AS contexts_key FROM ev"))
def archive_keys(spark, sf):
    return venue_json.archive_keys(v.events(spark, sf).selectExpr("concat('C', user_id % 5) AS coin", "cast(ts AS date) AS date", "hour(ts) AS hour").distinct())


@query("q_S10_l2_book", v.with_views("SELECT coin::varchar AS coin, ts_ms, bid_px, bid_sz, 1 + tie % 3 AS bid_n, ask_px, ask_sz, 2 AS ask_n FROM v_book").replace("1 + tie % 3 AS", "(1 + tie % 3)::int AS"))
def l2_book(spark, sf):
    """Snapshots in each of the three envelopes, by turns."""
    level = lambda px, sz, n: F.array(F.struct(F.col(px).cast("string").alias("px"), F.col(sz).cast("string").alias("sz"), n.cast("int").alias("n")))
    bare = F.struct(F.col("coin").cast("string").alias("coin"), F.col("ts_ms").alias("time"), F.array(level("bid_px", "bid_sz", 1 + F.col("tie") % 3), level("ask_px", "ask_sz", F.lit(2))).alias("levels"))
    data = F.struct(F.lit("l2Book").alias("channel"), bare.alias("data"))
    value = F.when(F.col("tie") % 3 == 0, F.to_json(bare)).when(F.col("tie") % 3 == 1, F.to_json(data)).otherwise(F.to_json(F.struct(data.alias("raw"))))
    return venue_json.top_of_book(venue_json.l2_book(v.book(spark, sf).select(value.alias("value"))))


@query("q_S16_nested_fills", v.with_views("SELECT 'C' || coin AS coin, tid, ts_ms, px, sz, side, crossed, fee FROM v_fills"))
def nested_fills(spark, sf):
    """Fills under lists and wrappers of growing depth."""
    fill = F.to_json(F.struct(F.concat(F.lit("C"), "coin").alias("coin"), F.col("px").cast("string").alias("px"), F.col("sz").cast("string").alias("sz"), F.when(F.col("side") == "B", "buy").otherwise("ask").alias("side"), F.col("ts_ms").alias("time"), F.col("crossed").cast("string").alias("crossed"), "tid", F.col("fee").cast("string").alias("fee")))
    wrapped, turn = fill, F.col("tid") % 4
    for i, (left, right) in enumerate((('{"fill":', "}"), ("[", "]"), ('{"userFills":[["user",', "]]}"))):
        wrapped = F.when(turn > i, F.concat(F.lit(left), wrapped, F.lit(right))).otherwise(wrapped)
    found = venue_json.typed_fills(venue_json.node_fills(v.fills(spark, sf).select(wrapped.alias("value"))))
    return found.select("coin", "tid", "ts_ms", "px", "sz", "side", "crossed", "fee")


@query("q_S13_contexts", v.with_views("SELECT 'C' || coin AS coin, funding, open_interest, oracle_px, mark_px, CASE WHEN tie % 2 = 0 THEN oracle_px ELSE mark_px END AS mid_px, 0e0 AS premium, CASE WHEN tie % 3 < 2 THEN ts_ms END AS ts_ms FROM v_ctx"))
def contexts(spark, sf):
    """Times as digits, as ISO text with nine decimals, or missing; mid and premium partly missing."""
    iso = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    at = F.when(F.col("tie") % 3 == 0, F.col("ts_ms").cast("string")).when(F.col("tie") % 3 == 1, F.concat(iso, F.lit("456789Z"))).otherwise("")
    text = lambda c: F.col(c).cast("string")
    rows = v.contexts(spark, sf).select(F.concat(F.lit("C"), "coin").alias("coin"), at.alias("time"), text("funding").alias("funding"), text("open_interest").alias("openInterest"), text("oracle_px").alias("oraclePx"), text("mark_px").alias("markPx"), F.when(F.col("tie") % 2 == 0, text("oracle_px")).otherwise("").alias("midPx"), F.lit("").alias("premium"))
    return venue_json.context_rows(rows)


@query("q_S14_times", v.with_views("SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts_ms WHEN 1 THEN ts_ms // 1000 * 1000 WHEN 2 THEN ts_ms END AS ts_ms FROM ev"))
def times(spark, sf):
    at = F.timestamp_millis("ts_ms")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" "), F.col("ts_ms").cast("string"))).when(F.col("event_id") % 4 == 1, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 4 == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'000001'")).otherwise("")
    return v.events(spark, sf).withColumn("text", text).select("event_id", venue_json.epoch_ms("text").alias("ts_ms"))


@query("q_S21_universe_contexts", v.with_views("SELECT 'C' || tie AS coin, funding, open_interest, oracle_px, mark_px FROM v_ctx"))
def universe_contexts(spark, sf):
    """Names and contexts paired by position; here one reply per user and minute."""
    text = lambda c: F.col(c).cast("string")
    one = F.struct(text("funding").alias("funding"), text("open_interest").alias("openInterest"), text("oracle_px").alias("oraclePx"), text("mark_px").alias("markPx"))
    replies = v.contexts(spark, sf).groupBy("coin", F.expr("ts_ms div 60000").alias("minute")).agg(F.sort_array(F.collect_list(F.struct("tie", one.alias("c")))).alias("rows"))
    names = F.transform("rows", lambda r: F.struct(F.concat(F.lit("C"), r["tie"]).alias("name")))
    value = F.concat(F.lit("["), F.to_json(F.struct(names.alias("universe"))), F.lit(","), F.to_json(F.transform("rows", lambda r: r["c"])), F.lit("]"))
    return venue_json.universe_contexts(replies.select(value.alias("value"))).select("coin", "funding", "open_interest", "oracle_px", "mark_px")


@query("q_S22_candles", v.with_views("SELECT coin::varchar AS coin, '1m' AS interval, ts_ms AS open_ts_ms, ts_ms + 59999 AS ts_ms, open, high, low, close, volume, trades AS trade_count FROM v_bars"))
def candles(spark, sf):
    """Candles as the API abbreviates them, then as the silver table keeps them."""
    text = lambda c: F.col(c).cast("string")
    value = F.concat(F.lit('{"t":'), text("ts_ms"), F.lit(',"T":'), (F.col("ts_ms") + 59999).cast("string"), F.lit(',"s":"'), text("coin"), F.lit('","i":"1m","o":"'), text("open"), F.lit('","h":"'), text("high"), F.lit('","l":"'), text("low"), F.lit('","c":"'), text("close"), F.lit('","v":"'), text("volume"), F.lit('","n":'), text("trades"), F.lit("}"))
    return lake.silver_candles(venue_json.candles(v.bars(spark, sf).select(value.alias("value"))))


@query("q_S31_canonical_events", v.with_views("SELECT event_type, count(*) AS n, round(sum(price), 4) AS total FROM (SELECT CASE event_type WHEN 'view' THEN 'trade' WHEN 'click' THEN 'kline' ELSE 'agg_trade' END AS event_type, CASE event_type WHEN 'click' THEN value + 1 ELSE value END AS price FROM ev) GROUP BY 1"))
def canonical_events(spark, sf):
    """Each event parsed by the fields of its own type."""
    kind = F.when(F.col("event_type") == "view", "trade").when(F.col("event_type") == "click", "kline").otherwise("agg_trade")
    value = F.to_json(F.struct(kind.alias("event_type"), F.col("ts_ms").alias("timestamp_ms"), F.lit("S").alias("symbol"), F.col("value").alias("price"), F.col("value").alias("open"), (F.col("value") + 1).alias("close"), F.lit(1.0).alias("quantity")))
    parsed = venue_json.parse_events(v.events(spark, sf).select(value.alias("value")))
    priced = [parsed[name].select("event_type", F.col(price).alias("price")) for name, price in (("trade", "price"), ("kline", "close"), ("agg_trade", "price"))]
    return priced[0].union(priced[1]).union(priced[2]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 4).alias("total"))


def _candle_rows(spark, sf):
    return v.bars(spark, sf).select(F.concat(F.lit("c/"), "coin").alias("coin"), "ts_ms", "close", "volume", "tie")


@query("q_K01_partitioned_write", v.with_views("SELECT 'C-' || coin AS coin, strftime(make_timestamp(ts_ms * 1000), '%Y%m%d') AS date, count(*) AS n, round(sum(close), 4) AS total FROM v_bars GROUP BY ALL"))
def partitioned_write(spark, sf):
    """Write the candles to their partitions, some twice, and read them back."""
    rows, root = _candle_rows(spark, sf), new_folder(spark)
    lake.write_table(rows, root, "candles")
    lake.write_table(rows.filter("ts_ms div 86400000 % 2 = 0"), root, "candles")
    return lake.read_table(spark, root, "candles").groupBy("coin", F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 4).alias("total"))


@query("q_K03_bronze_fills", v.with_views("SELECT tid, CASE WHEN coalesce(crossed, false) THEN -1 ELSE 1 END * CASE side WHEN 'B' THEN 1 ELSE -1 END AS maker_side, '{\"px\":' || px || ',\"tid\":' || tid || '}' AS raw_json FROM v_fills"))
def bronze_fills(spark, sf):
    fills = v.fills(spark, sf).withColumn("raw_json", F.to_json(F.struct("px", "tid")))
    return lake.bronze_fills(fills).select("tid", "maker_side", "raw_json")


@query("q_K05_silver_book_rows", v.with_views("SELECT tie, round((bid_px + ask_px) / 2, 6) AS mid, round((ask_px - bid_px) / ((bid_px + ask_px) / 2) * 10000, 6) AS spread_bps, round((bid_px * ask_sz + ask_px * bid_sz) / (bid_sz + ask_sz), 6) AS microprice, round((bid_sz - ask_sz) / (bid_sz + ask_sz), 6) + 0 AS top_imbalance FROM v_book"))
def silver_book_rows(spark, sf):
    rounded = [(F.round(c, 6) + 0).alias(c) for c in ("mid", "spread_bps", "microprice", "top_imbalance")]
    return lake.silver_book(v.book(spark, sf)).select("tie", *rounded)


@query("q_K06_silver_contexts", v.with_views("SELECT tie, funding, round((mark_px - oracle_px) / oracle_px * 10000, 6) + 0 AS basis_bps FROM v_ctx"))
def silver_contexts(spark, sf):
    return lake.silver_contexts(v.contexts(spark, sf)).select("tie", "funding", (F.round("basis_bps", 6) + 0).alias("basis_bps"))


@query("q_K10_event_round_trip", v.with_views("SELECT scenario_id, count(*) AS n, min(ts_ms) AS first_ms, round(sum(price * quantity), 4) AS notional FROM v_orders GROUP BY 1"))
def event_round_trip(spark, sf):
    """Canonical orders written as Parquet and read by what they are needed for."""
    path = new_folder(spark)
    v.orders(spark, sf).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path).groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ms"), F.round(F.sum(F.col("price") * F.col("quantity")), 4).alias("notional"))


@query("q_S26_kline_day", v.with_views("SELECT tie, ts_ms, close FROM v_bars WHERE ts_ms // 86400000 = (SELECT max(ts_ms // 86400000) FROM v_bars)"))
def kline_day(spark, sf):
    """A day that the lake lacks gives way to the newest one."""
    path = lake.write_table(_candle_rows(spark, sf), new_folder(spark), "candles")
    return lake.newest_partition(spark, path, "19990101").select("tie", "ts_ms", "close")


_ASKED = ("C-1", "C-3", "C-9"), ("20240105", "20240106", "20300101")


@query("q_S30_training_partitions", v.with_views("WITH g AS (SELECT * FROM (SELECT unnest(['C-1', 'C-3', 'C-9']) AS coin), (SELECT unnest(['20240105', '20240106', '20300101']) AS date)), t AS (SELECT DISTINCT 'C-' || coin AS coin, strftime(make_timestamp(ts_ms * 1000), '%Y%m%d') AS date FROM v_bars) SELECT g.coin, g.date, t.coin IS NOT NULL AS there FROM g LEFT JOIN t USING (coin, date)"))
def training_partitions(spark, sf):
    path = lake.write_table(_candle_rows(spark, sf), new_folder(spark), "training_rows")
    return lake.resolve_partitions(spark, path, *map(list, _ASKED))


@query("q_U02_training_panel", v.with_views("SELECT 'C-' || coin AS coin, strftime(make_timestamp(ts_ms * 1000), '%Y%m%d') AS date, ts_ms, close, 'date=' || strftime(make_timestamp(ts_ms * 1000), '%Y%m%d') AS source FROM v_bars WHERE coin IN (1, 3) AND strftime(make_timestamp(ts_ms * 1000), '%Y%m%d') IN ('20240105', '20240106')"))
def training_panel(spark, sf):
    path = lake.write_table(_candle_rows(spark, sf), new_folder(spark), "training_rows")
    return lake.training_panel(spark, path, *map(list, _ASKED), ["ts_ms", "close"])


@query("q_K20_scenario_round_trip", v.with_views("WITH l AS (SELECT order_id, scenario_id, action, side, row_number() OVER (PARTITION BY scenario_id ORDER BY ts_ms, sequence) - 1 AS i, count(*) OVER (PARTITION BY scenario_id) AS n FROM v_orders) SELECT order_id AS event_id, scenario_id, 'quote_stuffing' AS family, n = 1 OR i >= floor(n * 0.25) AS unsafe, 'agent_order:' || action || ':' || side AS mark FROM l"))
def scenario_round_trip(spark, sf):
    """Scenarios written as events, labels and manifest, and read back as examples."""
    from tidelake.operators import scenarios

    events = v.orders(spark, sf).withColumn("family", F.lit("quote_stuffing")).withColumnRenamed("order_id", "event_id")
    labels = scenarios.label_unsafe(events, "scenario_id", ["ts_ms", "sequence"]).select("scenario_id", "event_id", "unsafe")
    root = new_folder(spark)
    lake.write_scenarios(events, labels, root)
    return lake.read_scenarios(spark, root).select("event_id", "scenario_id", "family", "unsafe", "mark")


@query("q_K15_leaderboard_file", v.with_views("SELECT scenario AS name, round(avg((p - y::int) ** 2), 6) AS brier, CASE WHEN scenario <> 'de' THEN round(avg(p), 6) END AS mean_p FROM v_scores GROUP BY scenario"))
def leaderboard_file(spark, sf):
    """Runs with different metrics in one CSV; what a run lacks is empty."""
    p, y = F.col("p"), F.col("y").cast("double")
    runs = v.scores(spark, sf).groupBy(F.col("scenario").alias("name")).agg(F.round(F.avg(F.pow(p - y, 2)), 6).alias("brier"), F.round(F.avg("p"), 6).alias("mean_p"))
    metrics = F.map_filter(F.create_map(F.lit("brier"), F.col("brier"), F.lit("mean_p"), F.when(F.col("name") != "de", F.col("mean_p"))), lambda k, x: x.isNotNull())
    path = new_folder(spark)
    lake.write_leaderboard(runs.select("name", metrics.alias("metrics")), path)
    return spark.read.schema("name string, brier double, mean_p double").option("header", "true").csv(path)
