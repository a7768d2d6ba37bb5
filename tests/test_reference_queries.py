"""Every registered query against its DuckDB oracle, and golden vectors of the operators."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidelake import plans
from tidelake.functions import market
from tidelake.operators import orderflow, policy, scenarios, stats, temporal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_oracle(spark, sf_dir, duck, name):
    df, want = plans.QUERIES[name](spark, sf_dir), duck.sql(plans.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5


# The numbers in the tests from here on are published ones that results must equal.
def test_flagship_values(spark):
    """Values published with the blueprint, at sf0.01."""
    got = sorted(tuple(r) for r in plans.QUERIES["q_flagship_markout_by_coin"](spark, "/root/testdata/sf0.01").collect())
    assert got == [(0, 404, -6.759324, 0.492574, -0.10466), (1, 376, 2.646479, 0.473404, 0.061338), (2, 414, 12.868696, 0.451691, -0.001167), (3, 378, 1.869221, 0.460317, 0.08598), (4, 406, -3.928875, 0.485222, -0.100718)]


def book(spark, rows):
    return spark.createDataFrame([("c", *r, i) for i, r in enumerate(rows)], "coin string, ts_ms long, bid_px double, bid_sz double, ask_px double, ask_sz double, tie long")


def test_event_and_rolling_imbalance(spark):
    rows = book(spark, [(1000, 100.0, 10.0, 101.0, 10.0), (1500, 100.0, 12.0, 101.0, 8.0), (7000, 99.0, 9.0, 100.5, 11.0)])
    got = orderflow.with_rolling_ofi(rows, {"1s": 1000, "10s": 10000}).orderBy("ts_ms").collect()
    assert [round(r["ofi_event"], 9) for r in got] == [0, 0.1, -0.575]
    assert [round(r["ofi_1s"], 9) for r in got] == [0, 0.1, -0.575]
    assert round(got[2]["ofi_10s"], 9) == -0.475
    assert orderflow.with_event_ofi(book(spark, [(1, 1.0, 0.0, 2.0, 0.0), (2, 1.0, 0.0, 2.0, 0.0)])).filter("ofi_event <> 0").isEmpty()


def test_asof_takes_the_last_row_before_and_nearest_the_later_of_two(spark):
    left = spark.createDataFrame([("c", 2000)], "coin string, ts_ms long")
    right = spark.createDataFrame([("c", t, t // 100, i) for i, t in enumerate((1000, 1900, 2100, 1900))], "coin string, ts_ms long, v long, tie long")
    assert temporal.asof_backward(left, right, "coin", "r_").first()["r_ts_ms"] == 1900
    assert temporal.asof_backward(left, right, "coin", "r_", slice_ms=50).first()["r_ts_ms"] == 1900
    assert temporal.asof_nearest(left, right, "coin", "r_").first()["r_ts_ms"] == 2100
    assert temporal.asof_forward(left, right, "coin", "r_", 100).first()["r_ts_ms"] == 2100
    assert temporal.asof_backward(left, right.filter("ts_ms > 2000"), "coin", "r_").isEmpty()
    assert temporal.asof_forward(left, right, "coin", "r_", 200, how="left").first()["r_ts_ms"] is None


def test_slices_change_nothing(spark):
    import random

    rng = random.Random(1)
    left = spark.createDataFrame([(i % 3, rng.randrange(1000), i) for i in range(300)], "coin long, ts_ms long, id long")
    right = spark.createDataFrame([(i % 3, rng.randrange(1000), i, i) for i in range(200)], "coin long, ts_ms long, v long, tie long")
    one = sorted(map(tuple, temporal.asof_backward(left, right, "coin", "r_", "left").collect()), key=str)
    assert sorted(map(tuple, temporal.asof_backward(left, right, "coin", "r_", "left", slice_ms=37).collect()), key=str) == one


def test_prefix_window_leaves_out_later_rows_of_the_same_time(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("c", 10, 1, 1.0), ("c", 10, 2, 2.0), ("c", 15, 3, 4.0), ("c", 16, 4, 8.0)], "k string, ts_ms long, tie long, x double")
    got = rows.select("tie", temporal.prefix_window_sum(F.col("x"), ["k"], 5).alias("s")).orderBy("tie").collect()
    assert [r["s"] for r in got] == [1.0, 3.0, 7.0, 12.0]


def test_markouts_and_sides(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(100.0, 99.0, 1), (100.0, 101.0, 1), (100.0, 101.0, -1)], "px double, mid double, side int")
    assert [round(r[0], 6) for r in rows.select(market.markout_bps(F.col("side"), F.col("mid"), F.col("px"))).collect()] == [-100, 100, -100]
    sides = spark.createDataFrame([("buy ",), ("ASK",), ("long",)], "side string").select(market.normalised_side())
    assert [r[0] for r in sides.collect()] == ["B", "A", "B"]
    with pytest.raises(Exception, match="unknown side"):
        spark.createDataFrame([("?",)], "side string").select(market.normalised_side()).collect()


def scored(spark, p, y, markout=None):
    return spark.createDataFrame(list(zip(p, y, markout or [0.0] * len(p), strict=True)), "p double, y boolean, markout double")


def test_fold_golden_values(spark):
    rows = scored(spark, [0.1, 0.9, 0.2, 0.8], [False, True, False, True], [1.0, -5.0, 2.0, -4.0])
    assert stats.pr_auc_grouped(rows).first()[0] == stats.pr_auc_optimistic(rows).first()[0] == stats.auroc(rows).first()[0] == 1.0
    assert abs(rows.agg(stats.brier()).first()[0] - 0.025) < 1e-12
    assert abs(stats.calibration_error(rows, 2).first()[0] - 0.15) < 1e-12


def test_threshold_golden_values(spark):
    sweep = stats.threshold_sweep(scored(spark, [0.1, 0.2, 0.7, 0.8], [False] * 4, [2.0, 1.0, -5.0, -4.0]), [0.15, 0.5, 0.9])
    best = stats.select_threshold(sweep, 0.2, 0.6).first()
    assert (best["threshold"], best["lift"], best["quote_rate"], best["eligible"]) == (0.5, 2.25, 0.5, True)
    none = stats.select_threshold(stats.threshold_sweep(scored(spark, [0.1, 0.2], [False] * 2), [0.0]), 0.5, 0.8).first()
    assert (none["threshold"], none["quote_rate"], none["eligible"]) == (0.0, 0.0, False)


def test_drift_golden_values(spark):
    same, shifted = spark.range(100).selectExpr("double(id) AS v"), spark.range(100).selectExpr("double(id + 50) AS v")
    assert stats.psi(same, same, "v").first()[0] == 0 and stats.ks(same, same, "v").first()[0] == 0
    assert stats.psi(same, shifted, "v").first()[0] > 0.25
    assert stats.ks(same, spark.range(200, 300).selectExpr("double(id) AS v"), "v").first()[0] == 1.0
    assert stats.psi(same, shifted, "v", bins=1).first()[0] == 0


def test_exclusive_percentile(spark):
    from pyspark.sql import functions as F

    one_to_twenty = spark.range(1, 21).agg(F.sort_array(F.collect_list(F.col("id").cast("double"))).alias("x"))
    assert one_to_twenty.select(stats.exclusive_p95(F.col("x"))).first()[0] == 19.95
    assert spark.createDataFrame([([3.0],), ([],)], "x array<double>").select(stats.exclusive_p95(F.col("x"))).collect() == [(3.0,), (0.0,)]


def test_folds(spark):
    times = spark.createDataFrame([(t,) for t in (0, 10, 20, 30, 40, 50)], "ts_ms long")
    got = {r["fold"]: (r["n_test"], r["n_train"]) for r in stats.purged_train_sizes(stats.with_folds(times, 3, ["ts_ms"]), 10, 10).collect()}
    assert got[1] == (2, 2)
    five = stats.with_folds(spark.range(5).withColumnRenamed("id", "ts_ms"), 2, ["ts_ms"]).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in five] == [3, 2]


def test_rules(spark):
    clean = dict.fromkeys(policy.FEATURES)
    rows = [clean, clean | {"burst": 16.0}, clean | {"burst": 16.0, "cancel_rate": 0.5}]
    df = spark.createDataFrame([tuple(r[f] for f in policy.FEATURES) for r in rows], ", ".join(f"{f} double" for f in policy.FEATURES))
    got = df.withColumn("matched_rules", policy.matched_rules()).select(policy.rule_action()).collect()
    assert [r[0] for r in got] == ["allow", "alert", "block"]


def test_generated_sequences(spark):
    rows = scenarios.generate_orders(spark, 10, 100.0).filter("family = 'coordinated_burst'")
    assert [r["at_ms"] for r in rows.orderBy("i").collect()] == [0, 12, 24, 36, 48, 600, 72, 84, 96, 108]
    fast = scenarios.safety_variant(rows, "family", 100.0, True).agg({"at_ms": "max"}).first()[0]
    slow = scenarios.safety_variant(rows, "family", 100.0, False).agg({"at_ms": "max"}).first()[0]
    assert (fast, slow) == (72, 2250)
