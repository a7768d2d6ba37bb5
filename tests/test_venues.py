"""The venue by argument, setting or default, and one shape of both."""

import pytest

from tidelake.operators import lake
from tidelake.sources import venues


def test_which_venue(spark):
    assert venues.venue(spark) is venues.VENUES["exchange"]
    assert venues.venue(spark, " Perpetual ") is venues.VENUES["perpetual"]
    spark.conf.set(venues.SETTING, "perpetual")
    try:
        assert venues.venue(spark) is venues.VENUES["perpetual"]
        assert venues.venue(spark, "exchange") is venues.VENUES["exchange"]
    finally:
        spark.conf.unset(venues.SETTING)
    with pytest.raises(ValueError, match="unknown venue moon; there are exchange, perpetual"):
        venues.venue(spark, "moon")


def test_both_give_bars_and_depth_alike(spark, tmp_path):
    root = str(tmp_path)
    bars = "symbol string, timestamp timestamp, open double, high double, low double, close double, volume double"
    at = spark.sql("select timestamp_millis(5000) as t").first()["t"]
    spark.createDataFrame([("ABC", at, 1.0, 3.0, 0.5, 2.0, 9.0)], bars).write.parquet(f"{root}/klines")
    spark.createDataFrame([("ABC", at, -1.0, 2.0, 198.0)], "symbol string, timestamp timestamp, percentage double, depth double, notional double").write.parquet(f"{root}/bookDepth")
    lake.write_table(spark.createDataFrame([("ABC", 5000, 1.0, 3.0, 0.5, 2.0, 9.0)], "coin string, ts_ms long, open double, high double, low double, close double, volume double"), root, "candles")
    lake.write_table(spark.createDataFrame([("ABC", 5000, 99.0, 101.0, 2.0, 4.0)], "coin string, ts_ms long, bid_px double, ask_px double, bid_sz double, ask_sz double"), root, "l2_book")
    a, b = venues.venue(spark, "exchange"), venues.venue(spark, "perpetual")
    assert tuple(a.bars(spark, root).first()) == tuple(b.bars(spark, root).first()) == ("ABC", 5000, 1.0, 3.0, 0.5, 2.0, 9.0)
    assert a.depth(spark, root).columns == b.depth(spark, root).columns
    rows = sorted((r["symbol"], r["ts_ms"], round(r["percentage"], 9), r["depth"], r["notional"]) for r in b.depth(spark, root).collect())
    assert rows == [("ABC", 5000, -1.0, 2.0, 198.0), ("ABC", 5000, 1.0, 4.0, 404.0)]
