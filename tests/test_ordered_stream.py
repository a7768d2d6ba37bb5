"""Order and rolling state on streams: out of order within the delay, behind it, over restarts."""

import random

import pytest
from pyspark.sql import functions as F

from tidelake.operators import temporal
from tidelake.plans import adapters
from tidelake.streaming import ordered_stream

SCHEMA = "k string, ts_ms long, sequence long, x double"


@pytest.fixture(scope="module")
def stateful(spark):
    before = {c: spark.conf.get(c, None) for c in ordered_stream.STATE_STORE}
    for c, value in ordered_stream.STATE_STORE.items():
        spark.conf.set(c, value)
    yield spark
    for c, value in before.items():
        spark.conf.set(c, value) if value else spark.conf.unset(c)


class Feed:
    """A folder of files, one for each batch."""

    def __init__(self, spark, path, schema=SCHEMA):
        self.spark, self.path, self.schema, self.n = spark, path, schema, 0

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


def drained(rows, out, checkpoint, side=None):
    """Runs to the end of what is there, and stops: the next call is a restart."""
    if side:
        q = ordered_stream.routed(rows, out, side).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(300)
    if q.exception():
        raise q.exception()


def test_rows_are_sorted_within_the_delay_and_late_ones_routed(stateful, tmp_path):
    out, side, state = (str(tmp_path / n) for n in ("out", "side", "state"))
    feed = Feed(stateful, str(tmp_path / "in"))
    feed.add([("a", 100, 1, 1.0), ("a", 90, 0, 1.0), ("b", 5, 1, None), ("a", 105, 3, 1.0), ("a", 105, 2, 1.0)])
    drained(ordered_stream.in_order(feed.stream(), "k", 10), out, state, side)
    assert sorted((r["k"], r["ts_ms"], r["sequence"]) for r in stateful.read.parquet(out).collect()) == [("a", 90, 0)]
    feed.add([("a", 97, 4, 1.0), ("a", 120, 5, 1.0)])  # 97 is behind 100, but not behind the clock at 95
    drained(ordered_stream.in_order(feed.stream(), "k", 10), out, state, side)
    feed.add([("a", 110, 6, 2.0), ("a", 96, 7, 3.0), ("a", 200, 8, 1.0), ("b", 16, 2, None)])  # both lie behind the clock at 110
    drained(ordered_stream.in_order(feed.stream(), "k", 10), out, state, side)
    rows = stateful.read.parquet(out).orderBy("k", "batch", "ts_ms", "sequence").collect()
    assert [(r["k"], r["ts_ms"], r["sequence"]) for r in rows] == [("a", 90, 0), ("a", 97, 4), ("a", 100, 1), ("a", 105, 2), ("a", 105, 3), ("a", 120, 5), ("b", 5, 1)]
    assert sorted((r["ts_ms"], r["x"]) for r in stateful.read.parquet(side).collect()) == [(96, 3.0), (110, 2.0)]


def test_a_clock_that_runs_backwards_is_an_error_where_asked(stateful, tmp_path):
    feed = Feed(stateful, str(tmp_path / "in"))
    feed.add([("a", 100, 1, 1.0)])
    drained(ordered_stream.in_order(feed.stream(), "k", 10, strict=True), str(tmp_path / "out"), str(tmp_path / "state"))
    feed.add([("a", 50, 2, 1.0)])
    with pytest.raises(Exception, match="a row at 50 comes after"):
        drained(ordered_stream.in_order(feed.stream(), "k", 10, strict=True), str(tmp_path / "out"), str(tmp_path / "state"))


def test_rolling_state_equals_the_batch_over_a_restart(stateful, sf_dir, tmp_path):
    window, delay = 6 * adapters.HOUR, adapters.HOUR
    orders = adapters.orders(stateful, sf_dir).select(F.col("scenario_id").cast("string").alias("k"), "ts_ms", F.col("sequence").cast("long").alias("sequence"), F.col("quantity").alias("x"))
    rows = [tuple(r) for r in orders.collect()]
    rng = random.Random(2)
    rows.sort(key=lambda r: r[1] + rng.random() * delay * 0.9)  # out of order, but within the delay
    feed, out, state = Feed(stateful, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")
    third = len(rows) // 3
    for a in (0, third):
        feed.add(rows[a : a + third])
    drained(ordered_stream.rolling_state(feed.stream(), "k", "x", window, delay), out, state)
    feed.add(rows[2 * third :])
    drained(ordered_stream.rolling_state(feed.stream(), "k", "x", window, delay), out, state)
    got = {(r["k"], r["sequence"]): r for r in stateful.read.parquet(out).collect()}
    want = temporal.rolling_sums(orders, "k", {"n": F.lit(1).cast("long"), "x": F.col("x")}, {"w": window}, "sequence").collect()
    last = {}
    for k, ts, *_ in rows:
        last[k] = max(ts, last.get(k, ts))
    flushed = [r for r in want if r["ts_ms"] <= last[r["k"]] - delay]
    assert len(got) == len(flushed) > len(rows) // 2
    for r in flushed:
        own = got[r["k"], r["sequence"]]
        assert not own["late"]
        assert (own["n"], round(own["total"], 6)) == (r["n_w"], round(r["x_w"], 6))
    assert max(r["held"] for r in got.values()) <= 2 * max(r["n_w"] for r in want)  # state doesn't grow with the stream
