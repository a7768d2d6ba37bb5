"""Specs as people write them, and constraints of the seven event types."""

import pytest
from pyspark.sql import functions as F

from tidelake.functions import specs
from tidelake.operators import constraints


def read(spark, f, spec):
    return spark.createDataFrame([(spec,)], "s string").select(f(F.col("s"))).first()[0]


def test_specs(spark):
    assert read(spark, specs.symbols, " sol, btc/usd ,SOL") == ["SOL", "BTC-USD"]
    assert read(spark, specs.dates, "20240228..20240301, 20240228,20231231") == ["20240228", "20240229", "20240301", "20231231"]
    assert read(spark, specs.thresholds, "0.1:0.3:0.1") == [0.1, 0.2, 0.3]
    assert read(spark, specs.thresholds, "0.5, 0.25,0.5") == [0.5, 0.25]
    assert read(spark, specs.hours, "0-2,23,1") == [0, 1, 2, 23]


@pytest.mark.parametrize(("f", "spec", "says"), [
    (specs.symbols, " , ", "at least one"), (specs.dates, "2024-01-01", "not a date"), (specs.dates, "20240102..20240101", "runs backwards"), (specs.thresholds, "0.1:0.3", "not a threshold grid"),
    (specs.thresholds, "0.1:0.3:0", "not a threshold grid|zero|ZERO"), (specs.thresholds, "0.5,1.5", "not a threshold grid"), (specs.hours, "5-24", "not hours"), (specs.hours, "7-3", "not hours"),
])
def test_bad_specs_are_errors(spark, f, spec, says):
    with pytest.raises(Exception, match=says):
        read(spark, f, spec)


GOOD = {
    "agg_trade": "1 as ts_ms, 0 as sequence, 'ABC' as symbol, 1D as price, 1D as quantity, 1 as aggregate_trade_id, 1 as first_trade_id, 1 as last_trade_id, true as is_buyer_maker",
    "trade": "1 as ts_ms, 0 as sequence, 'ABC' as symbol, 1D as price, 1D as quantity, 1 as trade_id, 'buy' as side",
    "hyperliquid_fill": "1 as ts_ms, 0 as sequence, 'ABC' as symbol, 1D as price, 1D as quantity, cast(null as int) as trade_id, 'sell' as side, -1 as maker_side, cast(null as double) as fee",
    "book_ticker": "1 as ts_ms, 0 as sequence, 'ABC' as symbol, 1 as update_id, 1D as bid_price, 2D as ask_price, 0D as bid_quantity, 0D as ask_quantity",
    "book_depth": "1 as ts_ms, 0 as sequence, 'ABC' as symbol, -1D as percentage, 0D as depth, 0D as notional",
    "kline": "1 as ts_ms, 0 as sequence, 'ABC' as symbol, '1m' as interval, 2D as open, 3D as high, 1D as low, 2D as close, 1 as open_ts_ms, 1 as close_ts_ms, 0D as volume, 0 as trade_count",
    "agent_order": "1 as ts_ms, 0 as sequence, 'ABC' as symbol, 1D as price, 1D as quantity, 'buy' as side, 'new' as action, 's' as scenario_id, 'a' as agent_id, 'o' as order_id, 0D as remaining_quantity",
}
BAD = {"symbol": "'abc'", "ts_ms": "null", "price": "0D", "quantity": "cast(null as double)", "last_trade_id": "0", "side": "'up'", "maker_side": "0", "fee": "-1D", "ask_price": "1D", "depth": "-1D", "high": "1.5D", "close_ts_ms": "0", "remaining_quantity": "2D", "agent_id": "''", "action": "'halt'"}


@pytest.mark.parametrize("kind", GOOD)
def test_every_constraint_is_told_apart(spark, kind):
    good = spark.sql(f"select {GOOD[kind]}")
    assert constraints.violations(good, kind).count() == 0
    assert constraints.checked(good, kind).count() == 1
    for column, value in BAD.items():
        if column in good.columns:
            bad = good.withColumn(column, F.expr(value))
            assert constraints.violations(bad, kind).count() >= 1, column
            with pytest.raises(Exception, match=kind):
                constraints.checked(bad, kind).collect()
