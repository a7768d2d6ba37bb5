"""Order-flow features: event imbalance from the top of book, its rolling sums, and the rolling feature store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.operators.ordered import MOST_PARTS, estimated_bytes
from tidelake.operators.temporal import SLICE_MS, own_rows, prefix_window_sum, rolling_sums, sliced, window_firsts_and_extremes, with_previous


def with_event_ofi(book: DataFrame, key: str = "coin", slice_ms: int = SLICE_MS) -> DataFrame:
    """ofi_event: order-flow imbalance between consecutive quotes, by the four sizes; 0 on a key's first row or without size."""
    quote = ["bid_px", "ask_px", "bid_sz", "ask_sz"]
    was = {c: F.col(f"_previous.{c}") for c in quote}
    zero = F.lit(0.0)
    bid = F.when(F.col("bid_px") >= was["bid_px"], F.col("bid_sz")).otherwise(zero) - F.when(F.col("bid_px") <= was["bid_px"], was["bid_sz"]).otherwise(zero)
    ask = F.when(F.col("ask_px") <= was["ask_px"], F.col("ask_sz")).otherwise(zero) - F.when(F.col("ask_px") >= was["ask_px"], was["ask_sz"]).otherwise(zero)
    sizes = F.col("bid_sz") + F.col("ask_sz") + was["bid_sz"] + was["ask_sz"]
    event = F.when(was["bid_px"].isNull() | (sizes <= 0), zero).otherwise((bid - ask) / sizes)
    return with_previous(book, key, quote, slice_ms=slice_ms).withColumn("ofi_event", event).drop("_previous")


def with_rolling_ofi(book: DataFrame, windows: dict[str, int], key: str = "coin", peers: bool = False) -> DataFrame:
    """Rolling sums of ofi_event; all windows share one sort of each slice. ``peers``: quotes of one time count for each other."""
    return rolling_sums(with_event_ofi(book, key), key, {"ofi": F.col("ofi_event")}, windows, peers=peers)


ORDER_FEATURES = ("order_count", "buy_count", "sell_count", "cancel_count", "replace_count", "fill_count", "buy_ratio", "sell_ratio", "cancel_rate", "quantity_sum", "quantity_mean", "quantity_max", "price_mean", "price_min", "price_max", "price_range")
MARKET_FEATURES = ("notional_sum", "notional_mean", "aggressive_buy_count", "aggressive_sell_count", "price_drift", "quantity_imbalance")
AGENTIC_FEATURES = ("unique_agents", "unique_orders", "orders_per_agent", "min_interarrival_ms", "mean_interarrival_ms", "burst_rate_per_second", "self_cross_proxy_count", "opposite_side_same_price_pairs")
#: The 30 features by their full names.
SNAPSHOT = (*(f"order_{f}" for f in ORDER_FEATURES), *(f"market_{f}" for f in MARKET_FEATURES), *(f"agentic_{f}" for f in AGENTIC_FEATURES))
#: The extremes of a window, and which of them, or of its gaps, a feature is made from.
_EXTREMES = {"quantity_max": (F.max, "quantity"), "price_min": (F.min, "price"), "price_max": (F.max, "price")}
_FROM_EXTREMES = {"order_quantity_max": ("quantity_max",), "order_price_min": ("price_min",), "order_price_max": ("price_max",), "order_price_range": ("price_min", "price_max"), "agentic_min_interarrival_ms": ("min_gap",)}
#: What the features are made from: counts and sums of rows.
_ADDED = {"n": "1L", "buys": "int(side = 'buy')", "cancels": "int(action = 'cancel')", "replaces": "int(action = 'replace')", "fills": "int(action = 'fill')", "quantity": "quantity", "price": "price", "notional": "price * quantity", "bought": "if(side = 'buy', quantity, 0D)"}


def _snapshot(x: dict[str, Column]) -> dict[str, Column]:
    """The 30 features from sums (see _ADDED), extremes, first and last rows, distinct and pair counts."""
    n, one = x["n"], F.greatest(x["n"], F.lit(1))
    sells, duration = n - x["buys"], x["last_ms"] - x["first_ms"]
    order = (n, x["buys"], sells, x["cancels"], x["replaces"], x["fills"], x["buys"] / one, sells / one, x["cancels"] / one, x["quantity"], x["quantity"] / one, x["quantity_max"], x["price"] / one, x["price_min"], x["price_max"], x["price_max"] - x["price_min"])
    market = (x["notional"], x["notional"] / one, x["buys"], sells, x["last_price"] - x["first_price"], (2 * x["bought"] - x["quantity"]) / F.greatest(x["quantity"], F.lit(1e-9)))
    agentic = (x["agents"], x["orders"], n / F.greatest(x["agents"], F.lit(1)), F.coalesce(x["min_gap"], F.lit(0)), F.when(n > 1, duration / (n - 1)).otherwise(0.0), n / F.greatest(duration / 1000, F.lit(0.001)), x["self_crosses"], x["pairs"])
    return {name: F.coalesce(value.cast("double"), F.lit(0.0)) for name, value in zip(SNAPSHOT, (*order, *market, *agentic), strict=True)}


def feature_snapshot(orders: DataFrame, keys: list[str]) -> DataFrame:
    """The 30 features of each group of orders. Pairs of opposite orders are counted as buys times sells, not listed."""
    gap = F.col("ts_ms") - F.lag("ts_ms").over(Window.partitionBy(*keys).orderBy("ts_ms", "sequence"))
    at = F.struct("ts_ms", "sequence")
    sums = orders.withColumn("gap", gap).groupBy(*keys).agg(
        *[F.sum(F.expr(e)).alias(name) for name, e in _ADDED.items()], F.max("quantity").alias("quantity_max"), F.min("price").alias("price_min"), F.max("price").alias("price_max"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.min_by("price", at).alias("first_price"), F.max_by("price", at).alias("last_price"), F.min("gap").alias("min_gap")
    )
    # distinct agents and orders by groups of each, so that a group with very many is not one task's
    for name, column in (("agents", "agent_id"), ("orders", "order_id")):
        sums = sums.join(orders.groupBy(*keys, column).agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys)
    for name, same_agent in (("self_crosses", True), ("pairs", False)):
        sums = sums.join(self_cross_pairs(orders, keys, same_agent).withColumnRenamed("pairs", name), keys)
    return sums.select(*keys, *[c.alias(n) for n, c in _snapshot({c: F.col(c) for c in sums.columns}).items()])


#: Bytes of orders, by the optimiser's estimate, that a task of the feature store takes: its sorts together need many times that,
#: and the slices of a long window are so few and large that several meeting in one task count.
_STORE_BYTES = 320 << 10


def _parts_for(orders: DataFrame) -> int | None:
    """Tasks of the feature store, where its table is known to ask for more than a shuffle has."""
    size = estimated_bytes(orders)
    parts = min(MOST_PARTS, -(-size // _STORE_BYTES)) if size else 0
    return parts if parts > int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def feature_store(orders: DataFrame, windows: dict[str, int], key: str = "scenario_id", slice_ms: int | None = None, features: set[str] | None = None) -> DataFrame:
    """For each order and window ``{name}_`` and the 30 features of the orders in the closed window before it, per ``key``.

    ``features``: those to make, by their full names, if not all; what only others need is not sorted for.

    A window holds the rows from its start up to the current one in (ts_ms, sequence) order. For each window keys are
    cut into time slices, by default of its length, that hold a window's length before them, too, so every frame below is within (key, slice) and runs from
    its beginning. Sums are differences of running sums. A distinct count is a difference too: an agent enters with
    an order that follows its last one by more than the window, and leaves a window's length after an order that none
    follows. So is a count of pairs: an order adds those it makes with earlier ones, and takes away, when it leaves,
    those with later ones.
    """
    by = [key, "_slice"]
    step = Window.partitionBy(*by).orderBy("ts_ms", "sequence")
    buy = F.col("side") == "buy"
    counted = ("agents", "orders", "self_crosses", "pairs")
    parts = _parts_for(orders)
    out, made = orders, {name: [f for f in SNAPSHOT if features is None or f"{name}_{f}" in features] for name in windows}
    # Each window has a shuffle of its own, so that a task sorts for one only; what it finds goes on as one column.
    for name, ms in sorted(((n, ms) for n, ms in windows.items() if made[n]), key=lambda w: -w[1]):
        of_window = {c for f in made[name] for c in _FROM_EXTREMES.get(f, ())}
        extremes = {c: e for c, e in _EXTREMES.items() if c in of_window}
        out = sliced(out, key, ms, slice_ms or ms, parts)
        out = out.withColumns({f"_{added}": F.expr(e) for added, e in _ADDED.items()} | {"_buy": buy.cast("long"), "_sell": (~buy).cast("long")})
        new = {}
        for of, column in (("agents", "agent_id"), ("orders", "order_id")):
            own = Window.partitionBy(*by, column).orderBy("ts_ms", "sequence")
            since, until = F.col("ts_ms") - F.lag("ts_ms").over(own), F.lead("ts_ms").over(own) - F.col("ts_ms")
            new |= {f"_{of}_{way}": (F.coalesce(far, F.lit(ms + 1)) > ms).cast("long") for way, far in (("in", since), ("out", until))}
        for of, group in (("self_crosses", [*by, "price", "agent_id"]), ("pairs", [*by, "price"])):
            met = {side: prefix_window_sum(F.col(side), group, ms, "sequence") for side in ("_buy", "_sell")}
            until = Window.partitionBy(*group).orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, ms)
            so_far = Window.partitionBy(*group).orderBy("ts_ms", "sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            meets = {side: F.sum(side).over(until) - F.sum(side).over(so_far) for side in ("_buy", "_sell")}
            new |= {f"_{of}_in": F.when(buy, met["_sell"]).otherwise(met["_buy"]), f"_{of}_out": F.when(buy, meets["_sell"]).otherwise(meets["_buy"])}
        out = out.withColumns(new)
        out = window_firsts_and_extremes(out, by, ms, "sequence", ["ts_ms", "price"], extremes, "min_gap" in of_window)
        gone = Window.partitionBy(*by).orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, -(ms + 1))
        so_far = step.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        x = {c: prefix_window_sum(F.col(f"_{c}"), by, ms, "sequence") for c in _ADDED}
        x |= {c: F.sum(f"_{c}_in").over(so_far) - F.coalesce(F.sum(f"_{c}_out").over(gone), F.lit(0)) for c in counted}
        x |= {c: F.col(f"_{c}") if c in of_window else F.lit(None) for c in (*_EXTREMES, "min_gap")} | {"first_ms": F.col("_first.ts_ms"), "first_price": F.col("_first.price"), "last_ms": F.col("ts_ms"), "last_price": F.col("price")}
        raw = {c: f"_raw_{c}" for c in x}
        out = own_rows(out.withColumns({raw[c]: column for c, column in x.items()}))
        found = _snapshot({c: F.col(r) for c, r in raw.items()})
        out = out.withColumn(f"store_{name}", F.struct(*[found[f].alias(f) for f in made[name]]))
        out = out.drop(*[c for c in out.columns if c.startswith("_")])
    return out.select(*orders.columns, *[F.col(f"store_{name}.{f}").alias(f"{name}_{f}") for name in windows for f in made[name]])


def rule_sources(short: str, middle: str, long: str) -> dict[str, str]:
    """The store's feature behind each of the rules' names, from windows of a second, five seconds and a minute or their stand-ins."""
    # The window and feature behind each of the rules' names.
    return {
        "burst": f"{short}_agentic_burst_rate_per_second", "quantity_sum": f"{middle}_order_quantity_sum", "sell_ratio": f"{middle}_order_sell_ratio", "min_interarrival": f"{short}_agentic_min_interarrival_ms", "drift": f"{long}_market_price_drift", "cancel_rate": f"{short}_order_cancel_rate",
        "self_cross": f"{middle}_agentic_self_cross_proxy_count", "agents": f"{short}_agentic_unique_agents", "price_range": f"{middle}_order_price_range", "quantity_max": f"{middle}_order_quantity_max",
    }


def rule_features(store: DataFrame, short: str, middle: str, long: str) -> DataFrame:
    """The store with the columns that the rules read."""
    return store.withColumns({name: F.col(column) for name, column in rule_sources(short, middle, long).items()})


def self_cross_pairs(orders: DataFrame, keys: list[str], same_agent: bool = True) -> DataFrame:
    """Pairs of opposite orders at one price per group, counted as buys times sells instead of by a self join."""
    by = [*keys, "price", *(["agent_id"] if same_agent else [])]
    counts = orders.groupBy(*by).agg(F.count_if(F.col("side") == "buy").alias("buys"), F.count_if(F.col("side") == "sell").alias("sells"))
    return counts.groupBy(*keys).agg(F.sum(F.col("buys") * F.col("sells")).alias("pairs"))
