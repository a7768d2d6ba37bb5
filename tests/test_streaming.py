"""Streams driven to their end give what the batch operators give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelake.plans import adapters
from tidelake.streaming import orderflow_stream as stream


@pytest.fixture(scope="module")
def orders(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orders"))
    adapters.orders(spark, sf_dir).withColumn("ts", F.timestamp_millis("ts_ms")).repartitionByRange(4, "ts").write.mode("overwrite").parquet(path)
    return path


def finished(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return df.sparkSession.table(name)


def read(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def test_tumbling_windows_equal_the_batch(spark, orders):
    got = {(r["start"], r["scenario_id"]): r["n"] for r in finished(stream.tumbling_flow(read(spark, orders)), "tumbling").collect()}
    want = {(r["start"], r["scenario_id"]): r["n"] for r in stream.tumbling_flow(spark.read.parquet(orders)).collect()}
    assert got and all(want[k] == n for k, n in got.items())
    newest = max(k[0] for k in want)
    assert all(newest - k[0] <= dt.timedelta(hours=2) for k in want.keys() - got.keys())  # only open windows are held back


def test_sessions_and_duplicates(spark, orders):
    assert finished(stream.sessions(read(spark, orders)), "sessions").count() > 0
    twice = read(spark, orders).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    assert finished(stream.first_of_each_order(twice), "once").count() == spark.read.parquet(orders).count()


def test_matching_keeps_the_last_quote(spark, tmp_path):
    path = str(tmp_path / "in")
    t = dt.datetime(2024, 1, 1)
    rows = [
        (1, t, False, 1, 99.0, 101.0, 5.0, 2.0, None, None, None, None, None), (1, t + dt.timedelta(seconds=1), True, 2, None, None, None, None, 10, "new", "buy", 101.0, 3.0), (1, t + dt.timedelta(seconds=2), True, 3, None, None, None, None, 11, "new", "buy", 100.0, 3.0),
        (1, t + dt.timedelta(seconds=3), True, 4, None, None, None, None, 12, "cancel", "sell", 1.0, 3.0), (2, t, True, 5, None, None, None, None, 13, "new", "buy", 500.0, 3.0),
    ]
    spark.createDataFrame(rows, "coin long, ts timestamp, is_order boolean, sequence long, bid_px double, ask_px double, bid_sz double, ask_sz double, order_id long, action string, side string, price double, quantity double").write.parquet(path)
    got = finished(stream.matched_orders(read(spark, path)), "matched").collect()
    assert [tuple(r) for r in got] == [(1, 10, 101.0, 2.0)]


def test_upsert_keeps_the_latest(spark, tmp_path):
    write = stream.upsert_latest(str(tmp_path / "t"), "k", "at")
    write(spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k long, at long, x string"), 0)
    write(spark.createDataFrame([(1, 2, "c"), (2, 4, "d"), (3, 1, "e")], "k long, at long, x string"), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t") + "/v=1").collect())) == [(1, 2, "c"), (2, 5, "b"), (3, 1, "e")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        write(spark.createDataFrame([(1, 2, "c")], "k long, at long, x string"), 5)
