"""As-of joins against a plain search, on one key, across slices, with ties."""

import bisect
import random
import time

import pytest
from pyspark.sql import functions as F

from tidelake.operators import temporal
from tidelake.operators.orderflow import feature_store


def brute(left, right, horizon=0):
    """Of each left (key, ts, id): (last at or before, first at or after ts + horizon, nearest), as the right rows' values."""
    by = {}
    for key, ts, tie, value in right:
        by.setdefault(key, []).append((ts, tie, value))
    out = {}
    for key, ts, i in left:
        rows = sorted(by.get(key, []))
        times = [r[0] for r in rows]
        back, ahead, strictly = bisect.bisect_right(times, ts) - 1, bisect.bisect_left(times, ts + horizon), bisect.bisect_right(times, ts)
        before, after, later = (rows[n] if 0 <= n < len(rows) else None for n in (back, ahead, strictly))
        near = later if before is None or (later and later[0] - ts <= ts - before[0]) else before
        out[i] = tuple(r and r[2] for r in (before, after, near))
    return out


@pytest.mark.parametrize("slice_ms", [7, 40, 10_000])
def test_directions(spark, slice_ms):
    rng = random.Random(slice_ms)
    left = [(rng.choice("ab?"), rng.randrange(300), i) for i in range(120)]
    right = [(rng.choice("abc"), rng.randrange(-50, 280), i, 1000 + i) for i in range(90)]
    want = brute(left, right, 30)
    fills, quotes = spark.createDataFrame(left, "coin string, ts_ms bigint, tid int"), spark.createDataFrame(right, "coin string, ts_ms bigint, tie bigint, value int")
    found = [
        temporal.asof_backward(fills, quotes, "coin", "q_", "left", slice_ms),
        temporal.asof_forward(fills, quotes, "coin", "q_", 30, "left", slice_ms),
        temporal.asof_nearest(fills, quotes, "coin", "q_", slice_ms),
    ]
    for k, rows in enumerate(found):
        assert {r["tid"]: r["q_value"] for r in rows.collect()} == {i: x[k] for i, x in want.items()}
    inner = temporal.asof_forward(fills, quotes, "coin", "q_", 30, slice_ms=slice_ms).collect()
    assert {r["tid"] for r in inner} == {i for i, x in want.items() if x[1] is not None}


def test_one_key_of_many_rows_takes_linear_time(spark):
    """All of one key in one slice: a frame that is read anew for each row would take minutes."""
    left = spark.range(40_000).selectExpr("'a' as coin", "id * 3 as ts_ms", "id as tid")
    right = spark.range(40_000).selectExpr("'a' as coin", "id * 3 + 1 as ts_ms", "id as tie", "id as value")
    began = time.perf_counter()
    ahead = temporal.asof_forward(left, right, "coin", "q_", slice_ms=1 << 40).selectExpr("count(*) as n", "count_if(q_value = tid) as same").first()
    near = temporal.asof_nearest(left, right, "coin", "q_", slice_ms=1 << 40).selectExpr("count(*) as n", "count_if(q_value = tid) as same").first()
    assert tuple(ahead) == tuple(near) == (40_000, 40_000)
    assert time.perf_counter() - began < 40


def one_key(spark, n):
    """n orders of one key within the hour before each."""
    return spark.range(n).selectExpr(
        "1 as scenario_id", "id % 97 as agent_id", "id as order_id", "id as sequence", "id * 100 as ts_ms", "'new' as action", "if(hash(id) % 2 = 0, 'buy', 'sell') as side",
        "cast(100 + hash(id) % 5 as double) as price", "(abs(hash(id, 1)) % 1000) / 8D as quantity",
    )


def seconds(rows):
    began = time.perf_counter()
    rows.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def test_feature_store_of_one_hot_key_takes_linear_time(spark):
    windows = {"half": 800_000, "long": 10_000_000}
    feature_store(one_key(spark, 2000), windows).write.format("noop").mode("overwrite").save()
    once, twice = (min(seconds(feature_store(one_key(spark, n), windows)) for _ in range(2)) for n in (16_000, 32_000))
    assert twice < 2.2 * once + 3  # quadratic frames took four times as long


@pytest.mark.parametrize("slice_ms", [None, 40, 333])
def test_rolling_sums_and_last_rows_over_slices(spark, slice_ms):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(500), i, rng.choice([None, 1, 2, 3])) for i in range(300)]
    table = spark.createDataFrame(rows, "coin string, ts_ms bigint, tie bigint, x int")
    windows = {"w10": 10, "w40": 40}
    sums = {r["tie"]: r for r in temporal.rolling_sums(table, "coin", {"x": F.col("x"), "n": F.lit(1)}, windows, slice_ms=slice_ms).collect()}
    previous = {r["tie"]: r["_previous"] and r["_previous"]["tie"] for r in temporal.with_previous(table, "coin", ["tie"], slice_ms=slice_ms or 7).collect()}
    known = {r["tie"]: r["last"] for r in temporal.with_last_known(table, "coin", F.col("x"), "last", slice_ms=slice_ms or 7).collect()}
    assert len(sums) == len(previous) == len(known) == len(rows)
    for key in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for i, (_, ts, tie, _) in enumerate(own):
            for name, ms in windows.items():
                held = [r for r in own[: i + 1] if r[1] >= ts - ms]
                assert sums[tie][f"n_{name}"] == len(held)
                assert (sums[tie][f"x_{name}"] or 0) == sum(r[3] or 0 for r in held)
            assert previous[tie] == (own[i - 1][2] if i else None)
            assert known[tie] == next((r[3] for r in own[i::-1] if r[3] is not None), None)
