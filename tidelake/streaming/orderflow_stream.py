"""Streaming forms of the batch operators: windowed order flow, sessions, deduplication, latest-state matching.

The batch operators sort everything first and treat a clock that runs backwards as an error. On a stream a
watermark takes that part: rows later than it are left out of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_flow(orders: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts, notional and price range per scenario and window. ``orders`` has ts, scenario_id, side, price, quantity."""
    by = orders.withWatermark("ts", delay).groupBy(F.window("ts", width), "scenario_id")
    return by.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == "buy").alias("buys"), F.sum(F.col("price") * F.col("quantity")).alias("notional"), (F.max("price") - F.min("price")).alias("price_range")).select(F.col("window.start").alias("start"), "scenario_id", "n", "buys", "notional", "price_range")


def sliding_flow(orders: DataFrame, width: str = "6 hours", slide: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return orders.withWatermark("ts", delay).groupBy(F.window("ts", width, slide), "scenario_id").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity")).select(F.col("window.start").alias("start"), "scenario_id", "n", "quantity")


def sessions(orders: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    by = orders.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "agent_id")
    return by.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "agent_id", "n")


def first_of_each_order(orders: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """An order id counts once; its state is dropped when the watermark has passed."""
    return orders.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["order_id"])


#: What the matcher remembers of a coin: the last top of book.
STATE = "bid_px double, ask_px double, bid_sz double, ask_sz double"
FILLS = "coin long, order_id long, fill_px double, fill_qty double"


_TOP = ["bid_px", "ask_px", "bid_sz", "ask_sz"]


def _match(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["ts", "is_order", "sequence"], kind="stable").reset_index(drop=True)
    is_order = rows["is_order"].astype(bool)
    top = rows[_TOP].where(~is_order).ffill()
    if state.exists:
        top = top.fillna(dict(zip(_TOP, state.get, strict=True)))
    new = is_order & (rows["action"] == "new")
    buys = new & (rows["side"] == "buy") & (rows["price"] >= top["ask_px"])
    sells = new & (rows["side"] == "sell") & (rows["price"] <= top["bid_px"])
    touch, size = top["ask_px"].where(buys, top["bid_px"]), top["ask_sz"].where(buys, top["bid_sz"])
    found = pd.DataFrame({"coin": key[0], "order_id": rows["order_id"], "fill_px": touch, "fill_qty": size.where(size < rows["quantity"], rows["quantity"])})[buys | sells]
    last = top.iloc[-1] if len(top) else None
    if last is not None and pd.notna(last["bid_px"]):
        state.update(tuple(float(x) for x in last))
    yield found.astype({"order_id": "int64"})


def matched_orders(stream: DataFrame) -> DataFrame:
    """Fills of new orders against the latest quote of their coin; quotes and orders come as one stream with is_order."""
    return stream.groupBy("coin").applyInPandasWithState(_match, FILLS, STATE, "append", GroupStateTimeout.NoTimeout)


def upsert_latest(path: str, key: str, order: str):
    """A foreachBatch function that keeps of each key the latest row in a Parquet table of numbered versions.

    Only the first epoch may find no version before it; later on that is an error, as what was kept would be lost.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        known = batch.limit(0) if epoch == 0 else batch.sparkSession.read.parquet(f"{path}/v={epoch - 1}")
        both = known.unionByName(batch)
        best = both.groupBy(key).agg(F.max_by(F.struct(*both.columns), F.col(order)).alias("row")).select("row.*")
        best.write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return write
