"""Replay: quotes from depth ladders, scenario templates, risk ticks, cases in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.operators import policy

# Of each replay scenario the ten rule features (in the order of policy.FEATURES with cancel_rate,
# self_cross, agents as listed), side (EVEN: buy at even ticks), order offset and quantity, trade quantity and offset.
TEMPLATES = (
    ("spoofing_layering", 18.0, 4.2, 0.95, 4.0, 12.0, 0.65, 0.0, 1.0, 5.0, 5.0, "SELL", 5.0, 5.0, 0.0, 0.0),
    ("quote_stuffing", 45.0, 0.5, 0.5, 2.0, 1.0, 0.85, 0.0, 1.0, 5.0, 0.01, "SELL", 0.5, 0.01, 0.0, 0.0),
    ("momentum_ignition", 14.0, 8.5, 0.05, 15.0, 65.0, 0.12, 0.0, 1.0, 80.0, 10.0, "BUY", 12.0, 10.0, 8.0, 10.0),
    ("twap_execution", 1.0, 0.5, 0.1, 1200.0, 0.5, 0.04, 0.0, 1.0, 5.0, 0.05, "BUY", -0.5, 0.05, 0.05, -0.5),
    ("inventory_rebalancer", 2.0, 1.2, 0.45, 800.0, 1.5, 0.1, 0.0, 1.0, 5.0, 0.15, "EVEN", 0.0, 0.15, 0.15, 0.0),
    ("passive_market_maker", 3.5, 2.0, 0.5, 150.0, 0.2, 0.15, 0.0, 1.0, 5.0, 0.2, "EVEN", 0.0, 0.2, 0.1, 0.0),
)
TEMPLATE_SCHEMA = "scenario string, " + ", ".join(f"{f} double" for f in policy.FEATURES) + ", side_rule string, order_offset double, order_qty double, trade_qty double, trade_offset double"


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, TEMPLATE_SCHEMA)


def ladder(depth: DataFrame, keys: list[str]) -> DataFrame:
    """Depth rows as one ladder per snapshot, sorted by percentage."""
    return depth.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("percentage", "depth", "notional"))).alias("levels"))


def derived_quote(mid: Column, levels: Column, band: float = 1.0) -> tuple[Column, Column]:
    """Bid and ask at the ladder's inside levels; the band in percent where a side or the ladder is missing."""
    below = F.coalesce(F.array_max(F.transform(F.filter(levels, lambda x: x["percentage"] < 0), lambda x: x["percentage"])), F.lit(-band))
    above = F.coalesce(F.array_min(F.transform(F.filter(levels, lambda x: x["percentage"] > 0), lambda x: x["percentage"])), F.lit(band))
    return F.when(mid > 0, mid * (1 + below / 100)).otherwise(mid), F.when(mid > 0, mid * (1 + above / 100)).otherwise(mid)


def ticks(bars: DataFrame, scenario: str | None, order: list[str]) -> DataFrame:
    """One tick per bar (and scenario, if none is named): the scenario's order and trade around the close, rules, action and risk score."""
    template = templates(bars.sparkSession)
    if scenario:
        template = template.filter(F.col("scenario") == scenario)
    rows = bars.withColumn("idx", F.row_number().over(Window.partitionBy("coin").orderBy(*order)) - 1).join(F.broadcast(template))
    side = F.when(F.col("side_rule") == "EVEN", F.when(F.col("idx") % 2 == 0, "BUY").otherwise("SELL")).otherwise(F.col("side_rule"))
    rows = rows.withColumn("tick_side", side).withColumn("matched_rules", policy.matched_rules()).withColumn("action", policy.rule_action())
    return rows.withColumns({"order_px": F.col("close") + F.col("order_offset"), "trade_px": F.col("close") + F.col("trade_offset"), "risk_score": policy.by_name("action", policy.RISK_SCORES)})


def synthetic_features(spark: SparkSession, n: int | DataFrame, contamination: float = 0.18, noise: float = 0.55, seed: int = 42) -> DataFrame:
    """Labelled rows around the scenarios' features: scenario, idx, opposite, hostile and the features; idx runs up to ``n``, or over a table's.

    Row idx of a scenario is paired with the opposite family's idx-th template, round and round. A ``contamination``
    share of its features comes from there; each is multiplied by lognormal noise. Draws come from hashes of
    (seed, scenario, idx, feature), so they don't depend on how rows are dealt to tasks.
    """
    own = templates(spark).select("scenario", *policy.FEATURES).withColumn("hostile", F.size(policy.matched_rules()) > 0)
    family = Window.partitionBy("hostile").orderBy("scenario")
    own = own.withColumns({"nth": F.row_number().over(family) - 1, "of": F.count(F.lit(1)).over(Window.partitionBy("hostile"))})
    other = own.select(F.col("scenario").alias("opposite"), (~F.col("hostile")).alias("hostile"), F.col("nth").alias("other_nth"), F.col("of").alias("other_of"), *[F.col(f).alias(f"other_{f}") for f in policy.FEATURES])
    numbers = spark.range(n).withColumnRenamed("id", "idx") if isinstance(n, int) else n.select("idx")
    rows = numbers.join(F.broadcast(own)).join(F.broadcast(other), "hostile").filter("idx % other_of = other_nth")  # six templates
    uniform = lambda f, k: (F.pmod(F.xxhash64(F.lit(seed), "scenario", "idx", F.lit(f), F.lit(k)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    normal = lambda f: F.sqrt(-2 * F.log(uniform(f, 1))) * F.cos(2 * 3.141592653589793 * uniform(f, 2))
    drawn = {f: F.greatest(F.lit(0.0), F.when(uniform(f, 0) < contamination, F.col(f"other_{f}")).otherwise(F.col(f)) * F.exp(noise * normal(f))) for f in policy.FEATURES}
    return rows.select("scenario", "idx", "opposite", "hostile", *[c.alias(f) for f, c in drawn.items()])


def run_tables(ticks: DataFrame) -> dict[str, DataFrame]:
    """What a replay leaves behind: orders, trades of some quantity, alerts on what isn't allowed, and a trace of every tick."""
    base = ["tie", "coin", "ts_ms"]
    return {
        "orders": ticks.select(*base, "tick_side", "order_px", "order_qty"), "trades": ticks.filter("trade_qty > 0").select(*base, "trade_px", "trade_qty"),
        "alerts": ticks.filter("action <> 'allow'").select(*base, "action", "risk_score", "matched_rules"), "traces": ticks.select(*base, "action"),
    }
