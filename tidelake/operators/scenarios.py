"""Synthetic order flow: the agents' generators as column expressions over a range, safety variants, unsafe labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Of each family the time of order i in ms, when it buys, price as a multiple of mid when buying and
# selling, and quantity; all over i, the order's number from 0.
FAMILIES = {
    "passive_market_maker": ("100 * i", "i % 2 = 0", "0.999D", "1.001D", "0.01D"),
    "twap_execution": ("1000 * i", "true", "0.9995D", "0.9995D", "0.005D"),
    "inventory_rebalancer": ("750 * i", "i % 3 <> 0", "1D", "1D", "0.004D"),
    "spoofing_layering": ("50 * i", "false", "1D", "1.0005D + i * 1e-5D", "0.5D"),
    "quote_stuffing": ("5 * i", "i % 2 = 0", "0.9999D", "1.0001D", "0.001D"),
    "momentum_ignition": ("80 * i", "true", "1.001D + i * 2e-5D", "1D", "0.08D"),
    "synthetic_wash_like": ("40 * i", "i % 2 = 0", "1D", "1D", "0.03D"),
    "coordinated_burst": ("if(i % 5 = 0, 120, 12) * i", "i % 3 = 0", "1.0002D", "0.9998D", "0.04D"),
    "latency_edge": ("8 * i", "i % 4 IN (0, 1)", "1.0006D", "0.9994D", "0.006D"),
    "stop_run_sweep": ("30 * i", "true", "1.001D + i * 5e-5D", "1D", "0.06D"),
    "runaway_inventory": ("70 * i", "true", "1 + i * 3e-5D", "1D", "0.01D + 0.002D * i"),
    "volatility_feedback": ("20 * i", "i % 2 = 0", "1 + (0.001D + i * 2e-5D)", "1 - (0.001D + i * 2e-5D)", "0.02D + (i % 4) * 0.01D"),
}
BENIGN = ("passive_market_maker", "twap_execution", "inventory_rebalancer")
# From which share of a sequence on its events are unsafe; 0.5 for others.
UNSAFE_FROM = {"quote_stuffing": 0.25, "coordinated_burst": 0.25, "latency_edge": 0.25, "spoofing_layering": 0.5, "synthetic_wash_like": 0.5, "momentum_ignition": 0.6, "stop_run_sweep": 0.6, "runaway_inventory": 0.6, "volatility_feedback": 0.4}


def orders_of(numbered: DataFrame, mid: str, keep: list[str] | None = None) -> DataFrame:
    """Of every row, with an order's number ``i`` and a ``mid``, that order of every family; ``keep`` columns stay."""
    keep, out = keep or [], None
    for family, (at, buys, bid, ask, quantity) in FAMILIES.items():
        rows = numbered.select(*keep, F.lit(family).alias("family"), "i", F.expr(at).alias("at_ms"), F.expr(f"if({buys}, 'buy', 'sell')").alias("side"), (F.col(mid) * F.expr(f"if({buys}, {bid}, {ask})")).alias("price"), F.expr(quantity).cast("double").alias("quantity"), F.lit(family not in BENIGN).alias("unsafe_family"))
        out = rows if out is None else out.unionByName(rows)
    return out


def generate_orders(spark: SparkSession, count: int, mid: float) -> DataFrame:
    """``count`` orders of every family: family, i, at_ms, side, price, quantity, unsafe_family."""
    return orders_of(spark.range(count).select(F.col("id").alias("i"), F.lit(mid).alias("mid")), "mid")


def label_unsafe(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """unsafe: whether an event lies in the unsafe part of its sequence; a single event is unsafe."""
    by = Window.partitionBy(key)
    share = F.coalesce(F.create_map(*[F.lit(x) for kv in UNSAFE_FROM.items() for x in kv])[F.col("family")], F.lit(0.5))
    n, i = F.count(F.lit(1)).over(by), F.row_number().over(by.orderBy(*order)) - 1
    return events.withColumn("unsafe", (n == 1) | (i >= F.floor(n * share)))


def safety_variant(orders: DataFrame, key: str, mid: float, unsafe: bool) -> DataFrame:
    """Orders made plainly unsafe (fast, drifting, large) or plainly benign (slow, around the mid by turns, small)."""
    by = Window.partitionBy(key)
    i = F.row_number().over(by.orderBy("at_ms", "i")) - 1
    start = F.min("at_ms").over(by)
    if unsafe:
        several = F.min("price").over(by) < F.max("price").over(by)
        return orders.withColumns({"price": F.when(several, F.col("price") * (1 + 8e-5 * i)).otherwise(F.col("price")), "quantity": F.greatest("quantity", F.lit(0.08)), "at_ms": start + 8 * i})
    return orders.withColumns({"price": mid * (1 + F.when(i % 2 == 0, -5e-5).otherwise(5e-5)), "quantity": F.least("quantity", F.lit(0.01)), "at_ms": start + 250 * i})
