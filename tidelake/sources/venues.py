"""Where bars and depth come from: a venue by argument, else by the session's setting, else the default, behind one shape."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions import market
from tidelake.operators import lake

#: The session's setting that names the venue.
SETTING, DEFAULT = "spark.tidelake.venue", "exchange"


@dataclass(frozen=True)
class Venue:
    """Readers of a lake: bars (symbol, ts_ms, open, high, low, close, volume) and depth (symbol, ts_ms, percentage, depth, notional)."""

    bars: Callable[[SparkSession, str], DataFrame]
    depth: Callable[[SparkSession, str], DataFrame]


_BARS = ("symbol", "ts_ms", "open", "high", "low", "close", "volume")


def _exchange_bars(spark: SparkSession, root: str) -> DataFrame:
    """Parsed bar files as they came, by the time of their close."""
    return spark.read.parquet(f"{root}/klines").withColumn("ts_ms", F.unix_millis("timestamp")).select(*_BARS)


def _exchange_depth(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/bookDepth").select("symbol", F.unix_millis("timestamp").alias("ts_ms"), "percentage", "depth", "notional")


def _perpetual_bars(spark: SparkSession, root: str) -> DataFrame:
    return lake.read_table(spark, root, "candles").withColumnRenamed("coin", "symbol").select(*_BARS)


def _perpetual_depth(spark: SparkSession, root: str) -> DataFrame:
    """Top of book as two depth rows, by their signed distance from mid in per cent."""
    rows = lake.read_table(spark, root, "l2_book").withColumn("mid", market.mid())
    level = lambda side, sign: F.struct(
        (sign * F.abs((F.col(f"{side}_px") / F.col("mid") - 1) * 100)).alias("percentage"), F.col(f"{side}_sz").alias("depth"), (F.col(f"{side}_px") * F.col(f"{side}_sz")).alias("notional")
    )
    return rows.select(F.col("coin").alias("symbol"), "ts_ms", F.inline(F.array(level("bid", -1), level("ask", 1))))


VENUES = {"exchange": Venue(_exchange_bars, _exchange_depth), "perpetual": Venue(_perpetual_bars, _perpetual_depth)}


def venue(spark: SparkSession, name: str | None = None) -> Venue:
    asked = (name or spark.conf.get(SETTING, None) or DEFAULT).strip().lower()
    if asked not in VENUES:
        raise ValueError(f"unknown venue {asked}; there are {', '.join(sorted(VENUES))}")
    return VENUES[asked]
