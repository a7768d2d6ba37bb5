"""What events of each type must hold, and which rows break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMMON = {"symbol is not empty": "length(symbol) > 0", "symbol is in capitals": "symbol = upper(symbol)", "sequence is not negative": "sequence >= 0", "has a time": "ts_ms IS NOT NULL"}
_PRICED = {"price is positive": "price > 0", "quantity is positive": "quantity > 0"}
_SIDED = {"side is known": "side IN ('buy', 'sell')"}

#: Conditions by event type and name. One that a null leaves open is broken, unless it says otherwise.
CONSTRAINTS: dict[str, dict[str, str]] = {
    "agg_trade": _COMMON | _PRICED | {"ids are not negative": "least(aggregate_trade_id, first_trade_id, last_trade_id) >= 0", "ids are in order": "last_trade_id >= first_trade_id", "maker is known": "is_buyer_maker IS NOT NULL"},
    "trade": _COMMON | _PRICED | _SIDED | {"id is not negative": "trade_id >= 0"},
    "hyperliquid_fill": _COMMON | _PRICED | _SIDED | {"id is not negative": "trade_id IS NULL OR trade_id >= 0", "maker side is signed": "maker_side IN (-1, 1)", "fee is not negative": "fee IS NULL OR fee >= 0"},
    "book_ticker": _COMMON | {"id is not negative": "update_id >= 0", "prices are positive": "least(bid_price, ask_price) > 0", "quantities are not negative": "least(bid_quantity, ask_quantity) >= 0", "bid is below ask": "bid_price < ask_price"},
    "book_depth": _COMMON | {"percentage is known": "percentage IS NOT NULL", "depth is not negative": "depth >= 0", "notional is not negative": "notional >= 0"},
    "kline": _COMMON | {"interval is not empty": "length(interval) > 0", "prices are positive": "least(open, high, low, close) > 0", "high and low hold the others": "low <= least(open, close) AND high >= greatest(open, close)", "closes after it opens": "close_ts_ms >= open_ts_ms", "volume is not negative": "volume >= 0", "count is not negative": "trade_count >= 0"},
    "agent_order": _COMMON | _PRICED | _SIDED | {"ids are not empty": "least(length(scenario_id), length(agent_id), length(order_id)) > 0", "action is known": "action IN ('new', 'cancel', 'replace', 'fill')", "remaining is within quantity": "remaining_quantity BETWEEN 0 AND quantity"},
}


def broken(event_type: str) -> Column:
    """The names of the constraints that a row breaks, in order."""
    marks = [F.when(~F.coalesce(F.expr(f"({condition})"), F.lit(False)), F.lit(name)) for name, condition in CONSTRAINTS[event_type].items()]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def violations(rows: DataFrame, event_type: str) -> DataFrame:
    """event_type, constraint and n, for each constraint that some row breaks."""
    return rows.select(F.explode(broken(event_type)).alias("constraint")).groupBy(F.lit(event_type).alias("event_type"), "constraint").agg(F.count(F.lit(1)).alias("n"))


def checked(rows: DataFrame, event_type: str) -> DataFrame:
    """The rows, of which one that breaks a constraint is an error that names it."""
    names = broken(event_type)
    fine = F.when(F.size(names) == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{event_type}: "), F.array_join(names, ", "))).cast("boolean"))
    return rows.filter(fine)
