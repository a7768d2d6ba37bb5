"""Views of the driver tables that stand in for market data: order book, fills, contexts, orders, bars, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelake.session import table

#: Horizons that suit the density of the driver's events, in milliseconds.
HOUR = 3_600_000
#: The order of quotes and contexts of one millisecond in as-of joins: by their exact time, which ts_ms cuts, then by number.
IN_TIME = "struct(ts, event_id)"


def events(spark: SparkSession, sf: str) -> DataFrame:
    """events with epoch milliseconds (whatever the session's time zone) and the number in props."""
    return table(spark, sf, "events").selectExpr(
        "*", "cast(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000 as bigint) AS ts_ms", "cast(get_json_object(props, '$.k') as int) AS k"
    )


def book(spark: SparkSession, sf: str, tie: str = "event_id") -> DataFrame:
    return (
        events(spark, sf)
        .filter("event_type = 'view'")
        .selectExpr("user_id % 5 AS coin", "ts_ms", "100 + (k % 7) * 0.5D AS bid_px", "k", "cast(1 + k % 11 as double) AS bid_sz", "cast(1 + k % 13 as double) AS ask_sz", f"{tie} AS tie")
        .selectExpr("coin", "ts_ms", "bid_px", "bid_px + 0.5D + (k % 3) * 0.25D AS ask_px", "bid_sz", "ask_sz", "tie")
    )


def fills(spark: SparkSession, sf: str) -> DataFrame:
    return (
        events(spark, sf)
        .filter("event_type = 'purchase'")
        .selectExpr(
            "user_id % 5 AS coin", "ts_ms", "100 + (k % 9) * 0.5D AS px", "value AS sz", "if(event_id % 2 = 0, 'B', 'A') AS side", "CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS crossed", "value * 0.001D AS fee", "event_id AS tid"
        )
    )


def contexts(spark: SparkSession, sf: str, tie: str = "event_id") -> DataFrame:
    return (
        events(spark, sf)
        .filter("event_type = 'signup'")
        .selectExpr("user_id % 5 AS coin", "ts_ms", "(k - 50) * 1e-6D AS funding", "1000 + value AS open_interest", "cast(100 + k % 5 as double) AS oracle_px", "100 + k % 5 + (k % 4) * 0.1D AS mark_px", f"{tie} AS tie")
    )


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).selectExpr(
        "user_id % 20 AS scenario_id", "user_id AS agent_id", "event_id AS order_id", "event_id AS sequence", "ts_ms",
        "CASE event_type WHEN 'view' THEN 'new' WHEN 'click' THEN 'cancel' WHEN 'signup' THEN 'replace' WHEN 'purchase' THEN 'fill' ELSE 'new' END AS action",
        "if(event_id % 2 = 0, 'buy', 'sell') AS side", "cast(100 + k % 5 as double) AS price", "value / 1000 AS quantity", "event_type",
    )


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """One bar per error event and coin: a kline stand-in."""
    return events(spark, sf).filter("event_type = 'error'").selectExpr(
        "user_id % 5 AS coin", "ts_ms", "100 + k % 9 AS open_i", "k", "value AS volume", "event_id AS tie"
    ).selectExpr("coin", "ts_ms", "cast(open_i as double) AS open", "open_i + 2 + (k % 3) * 0.5D AS high", "open_i - 2 - (k % 4) * 0.5D AS low", "open_i + (k % 5) * 0.25D - 0.5D AS close", "volume", "cast(1 + k % 7 as bigint) AS trades", "tie")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Model scores with labels: (scenario, ts, p, y, markout)."""
    labels, documents = table(spark, sf, "labels"), table(spark, sf, "documents")
    return labels.join(documents.drop("text"), "doc_id").selectExpr("doc_id", "lang AS scenario", "doc_id * 1000 AS ts_ms", "(n_chars % 997) / 997.0D AS p", "toxic = 1 AS y", "(n_chars % 41) - 20.0D AS markout", "quality = 1 AS other")


#: The same views for DuckDB.
DUCK = """
ev AS (SELECT *, epoch_us(ts) // 1000 AS ts_ms, cast(json_extract_string(props, '$.k') AS int) AS k FROM events),
v_book AS (SELECT user_id % 5 AS coin, ts_ms, 100 + (k % 7) * 0.5e0 AS bid_px, 100 + (k % 7) * 0.5e0 + 0.5e0 + (k % 3) * 0.25e0 AS ask_px, (1 + k % 11)::double AS bid_sz, (1 + k % 13)::double AS ask_sz, event_id AS tie FROM ev WHERE event_type = 'view'),
v_fills AS (SELECT user_id % 5 AS coin, ts_ms, 100 + (k % 9) * 0.5e0 AS px, value AS sz, CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'A' END AS side, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS crossed, value * 0.001e0 AS fee, event_id AS tid FROM ev WHERE event_type = 'purchase'),
v_ctx AS (SELECT user_id % 5 AS coin, ts_ms, (k - 50) * 1e-6 AS funding, 1000 + value AS open_interest, (100 + k % 5)::double AS oracle_px, 100 + k % 5 + (k % 4) * 0.1e0 AS mark_px, event_id AS tie FROM ev WHERE event_type = 'signup'),
v_orders AS (SELECT user_id % 20 AS scenario_id, user_id AS agent_id, event_id AS order_id, event_id AS sequence, ts_ms, CASE event_type WHEN 'view' THEN 'new' WHEN 'click' THEN 'cancel' WHEN 'signup' THEN 'replace' WHEN 'purchase' THEN 'fill' ELSE 'new' END AS action, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, (100 + k % 5)::double AS price, value / 1000 AS quantity, event_type FROM ev),
v_bars AS (SELECT user_id % 5 AS coin, ts_ms, (100 + k % 9)::double AS open, 100 + k % 9 + 2 + (k % 3) * 0.5e0 AS high, 100 + k % 9 - 2 - (k % 4) * 0.5e0 AS low, 100 + k % 9 + (k % 5) * 0.25e0 - 0.5e0 AS close, value AS volume, (1 + k % 7)::bigint AS trades, event_id AS tie FROM ev WHERE event_type = 'error'),
v_scores AS (SELECT doc_id, lang AS scenario, doc_id * 1000 AS ts_ms, (n_chars % 997) / 997e0 AS p, toxic = 1 AS y, (n_chars % 41) - 20e0 AS markout, quality = 1 AS other FROM labels JOIN documents USING (doc_id))
"""


def with_views(sql: str) -> str:
    """A DuckDB statement over the views; its own CTEs may follow."""
    sql = sql.strip()
    return f"WITH {DUCK}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {DUCK} {sql}"
