"""Part-wise orders against plain ones, the rolling feature store against lists, memories and scores on odd rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidelake.operators import memory, models, ordered, orderflow, policy, replay, scoring, stats, tables


@pytest.fixture(scope="module")
def values():
    rng = random.Random(1)
    return [(i, rng.choice("ab"), rng.randrange(60)) for i in range(500)]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_running_sums_and_tiles(spark, values, parts):
    rows = spark.createDataFrame(values, "id int, k string, x int")
    got = {r["id"]: (r["s"], r["s_all"]) for r in ordered.running(rows, "x", {"s": F.col("x")}, ["k"], ["id"], descending=True, parts=parts).collect()}
    for key in "ab":
        so_far, whole = 0, sum(x for _, k, x in values if k == key)
        for i, _, x in sorted((v for v in values if v[1] == key), key=lambda v: (-v[2], v[0])):
            so_far += x
            assert got[i] == (so_far, whole)
    tiles = {r["id"]: r["tile"] for r in ordered.tiles(rows, 7, "x", ["id"], parts=parts).collect()}
    for n, (i, _, _) in enumerate(sorted(values, key=lambda v: (v[2], v[0]))):
        assert tiles[i] == (n // 72 if n < 216 else 3 + (n - 216) // 71)
    few = spark.createDataFrame(values[:3], "id int, k string, x int")
    assert sorted(r["tile"] for r in ordered.tiles(few, 5, "x", ["id"], parts=parts).collect()) == [0, 1, 2]
    assert ordered.tiles(rows.filter("false"), 5, "x").count() == 0


@pytest.mark.parametrize("parts", [None, 1, 3])
def test_null_keys_and_values_stay(spark, parts):
    values = [(1, None, 5), (2, "a", None), (3, None, 2), (4, "a", 7), (5, "a", 7), (6, None, None)]
    rows = spark.createDataFrame(values, "id int, k string, x int")
    got = {r["id"]: (r["n"], r["n_all"]) for r in ordered.running(rows, "x", {"n": F.lit(1)}, ["k"], ["id"], parts=parts).collect()}
    assert got == {6: (1, 3), 3: (2, 3), 1: (3, 3), 2: (1, 3), 4: (2, 3), 5: (3, 3)}
    ranks = {(r["k"], r["value"]): r["rank"] for r in ordered.average_ranks(rows, "x", ["k"], parts).collect()}
    assert ranks == {(None, None): 1, (None, 2): 2, (None, 5): 3, ("a", None): 1, ("a", 7): 2.5}
    assert {r["k"]: r["p"] for r in ordered.percentiles(rows, "x", {"p": 0.5}, ["k"], parts).collect()} == {None: 3.5, "a": 7.0}


@pytest.mark.parametrize("parts", [1, 7])
def test_percentiles_equal_sparks_own(spark, values, parts):
    rows = spark.createDataFrame([(i, k, x * x / 7) for i, k, x in values], "id int, k string, x double")
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.977, "e": 1.0}
    want = rows.groupBy("k").agg(*[F.percentile("x", F.lit(q)).alias(n) for n, q in shares.items()]).collect()
    got = {r["k"]: r for r in ordered.percentiles(rows, "x", shares, ["k"], parts).collect()}
    assert all(abs(got[r["k"]][n] - r[n]) < 1e-9 for r in want for n in shares)


def test_a_null_score_is_refused(spark):
    rows = spark.createDataFrame([(0.2, 1.0), (None, 100.0)], "p double, markout double")
    with pytest.raises(Exception, match="a score is null"):
        stats.threshold_sweep(rows, [0.1, 0.5]).collect()
    assert [r["quote_rate"] for r in stats.threshold_sweep(rows.filter("p is not null"), [0.1, 0.5]).collect()] == [0.0, 1.0]


def test_feature_store_against_lists(spark):
    """Ties in time, repeated agents, prices and orders, windows that hold one row or all."""
    rng = random.Random(3)
    rows = [(rng.choice([1, 2]), rng.choice("pqr"), f"o{rng.randrange(40)}", i, rng.randrange(0, 4000, 50), rng.choice(["new", "cancel", "replace", "fill"]), rng.choice(["buy", "sell"]), float(rng.randrange(100, 104)), rng.randrange(1, 9) / 4) for i in range(160)]
    orders = spark.createDataFrame(rows, "scenario_id int, agent_id string, order_id string, sequence int, ts_ms bigint, action string, side string, price double, quantity double")
    windows = {"a": 100, "b": 1000, "c": 100000}
    got = {r["sequence"]: r for r in orderflow.feature_store(orders, windows).collect()}
    for s, _, _, seq, ts, *_ in rows:
        before = sorted((r for r in rows if r[0] == s and (r[4], r[3]) <= (ts, seq)), key=lambda r: (r[4], r[3]))
        for name, ms in windows.items():
            w = [r for r in before if r[4] >= ts - ms]
            gaps = [y[4] - x[4] for x, y in zip(w, w[1:], strict=False)]
            pairs = [(x, y) for i, y in enumerate(w) for x in w[:i] if x[7] == y[7] and x[6] != y[6]]
            bought, sold = sum(r[8] for r in w if r[6] == "buy"), sum(r[8] for r in w if r[6] == "sell")
            want = {
                "order_order_count": len(w), "order_sell_ratio": sum(r[6] == "sell" for r in w) / len(w), "order_cancel_rate": sum(r[5] == "cancel" for r in w) / len(w), "order_quantity_max": max(r[8] for r in w), "order_price_range": max(r[7] for r in w) - min(r[7] for r in w), "order_price_mean": sum(r[7] for r in w) / len(w),
                "market_price_drift": w[-1][7] - w[0][7], "market_quantity_imbalance": (bought - sold) / (bought + sold), "agentic_unique_agents": len({r[1] for r in w}), "agentic_unique_orders": len({r[2] for r in w}), "agentic_min_interarrival_ms": min(gaps, default=0), "agentic_mean_interarrival_ms": sum(gaps) / len(gaps) if gaps else 0,
                "agentic_burst_rate_per_second": len(w) / max((ts - w[0][4]) / 1000, 0.001), "agentic_opposite_side_same_price_pairs": len(pairs), "agentic_self_cross_proxy_count": sum(x[1] == y[1] for x, y in pairs),
            }
            for feature, x in want.items():
                assert math.isclose(got[seq][f"{name}_{feature}"], x, abs_tol=1e-9), (seq, name, feature)
    one = {r["scenario_id"]: r for r in orderflow.feature_snapshot(orders, ["scenario_id"]).collect()}
    last = {s: max((r for r in rows if r[0] == s), key=lambda r: (r[4], r[3]))[3] for s in (1, 2)}
    assert all(math.isclose(one[s][f], got[last[s]][f"c_{f}"], abs_tol=1e-9) for s in (1, 2) for f in orderflow.SNAPSHOT)


def test_memories_grow_as_cases_come(spark):
    rng = random.Random(4)
    cases = [(i, rng.sample([r for r, _ in policy.RULES[:4]], rng.randint(0, 3)), rng.randrange(3)) for i in range(120)]
    cases = [(i, sorted(r), n) for i, r, n in cases]
    shelf, want = [], {}
    for i, rules, name in cases:
        likeness = [max(len(set(rules) & set(r)) / len(set(rules) | set(r)) if rules and r else 0, 0.6 if n == name else 0) for r, n in shelf]
        want[i] = 1 - max(likeness, default=0) >= memory.NOVELTY_THRESHOLD
        if want[i]:
            shelf.append((rules, name))
    got = memory.remembered(spark.createDataFrame(cases, "id int, rules array<string>, name int"), "id").collect()
    assert {r["id"]: r["novel"] for r in got} == want


def test_scorer_artifacts(spark):
    rows = spark.createDataFrame([(1, 2.0, None), (2, 0.0, 1.0)], "tid int, a double, flag double")
    probability = lambda x: x[0] / 4 + F.coalesce(x[1], F.lit(0.0))
    scorer = scoring.load_scorer(probability, {"feature_columns": ["a", "b"]}, {"decision_threshold": 0.5, "feature_columns": ["z"]})
    assert (scorer.columns, scorer.threshold, scorer.knots) == (("a", "b"), 0.5, None)
    assert scoring.load_scorer(probability, {"feature_columns": ["a"], "decision_threshold": 0.1}, {"decision_threshold": 0.5}, {"decision_threshold": 0.3}).threshold == 0.1
    with pytest.raises(ValueError, match="missing model features: b"):
        scoring.scored(rows, scorer)
    got = scoring.scored(rows, scorer, fill_missing=0.25).orderBy("tid").collect()
    assert [(r["raw_score"], r["action"]) for r in got] == [(0.75, "withhold_quote"), (0.25, "quote")]
    with pytest.raises(ValueError, match="neither"):
        scoring.load_scorer(probability, {}, {})


def test_risk_head_on_synthetic_rows(spark):
    rows = replay.synthetic_features(spark, 60).cache()
    assert rows.count() == 360 and rows.filter("hostile").count() == 180
    again = replay.synthetic_features(spark.newSession(), 60).agg(F.sum("burst")).first()[0]
    assert math.isclose(rows.agg(F.sum("burst")).first()[0], again)
    train, test = models.family_split(rows, ["quote_stuffing", "twap_execution"])
    assert test.count() == 120 and train.filter("scenario = 'quote_stuffing'").isEmpty()
    _, report = models.risk_head(train, test, list(policy.FEATURES), "hostile", trees=3)
    assert report["n"] == 120 and report["auroc"] > 0.6 and math.isclose(sum(report["importances"].values()), 1, abs_tol=1e-6)


def test_rows_without_features_are_kept_without_score(spark):
    rows = spark.range(100).selectExpr("id", "if(id % 10 = 0, null, double(id % 7)) AS a", "id % 7 > 3 AS y")
    model = models.fit_boosted(rows, ["a"], "y", trees=2)
    scored = models.score(model, rows, ["a"])
    assert scored.count() == 100 and scored.filter("p is null").count() == 10


def test_runs_count_once_their_marker_is_there(spark, tmp_path):
    root = str(tmp_path)
    tables.persist_run({"a": spark.range(3).toDF("x"), "b": spark.range(2).toDF("x")}, root, "r1")
    spark.range(5).toDF("x").withColumn("run_id", F.lit("r2")).write.parquet(f"{root}/a/run=r2")
    assert tables.read_run_table(spark, root, "a").count() == 3
    assert tables.read_run_table(spark, root, "b").count() == 2
