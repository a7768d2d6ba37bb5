"""The lake's writers and manifest, and out-of-fold training."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidelake.functions import market
from tidelake.operators import lake, models, stats


def test_partitions_are_overwritten_one_by_one(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("sol", 0, 1.0), ("btc/perp", 0, 2.0), ("sol", 86_400_000, 3.0)], "coin string, ts_ms long, px double")
    path = lake.write_table(rows, root, "candles")
    lake.write_table(spark.createDataFrame([("sol", 5, 9.0)], "coin string, ts_ms long, px double"), root, "candles")
    got = sorted((r["coin"], str(r["date"]), r["px"]) for r in lake.read_table(spark, root, "candles").collect())
    assert got == [("BTC-PERP", "19700101", 2.0), ("SOL", "19700101", 9.0), ("SOL", "19700102", 3.0)]
    with pytest.raises(ValueError, match="empty"):
        lake.write_table(rows.filter("false"), root, "candles")
    assert path.endswith("silver/candles")


def test_manifest_hashes_contents(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_bytes(name.encode() * 10)
    files = lake.manifest(spark, str(tmp_path))
    assert {r["sha256"] for r in files.collect()} == {hashlib.sha256(x * 10).hexdigest() for x in (b"a", b"b")}
    one, two = lake.manifest_hash(files).first(), lake.manifest_hash(files.orderBy(F.desc("path"))).first()
    assert one == two and one["n_files"] == 2 and one["bytes"] == 20


def test_silver_rows(spark):
    fill = spark.createDataFrame([("SOL", 1, 100.0, 2.0, "B", None, 0.1, "{}", 0.0)], "coin string, ts_ms long, px double, sz double, side string, crossed boolean, fee double, raw_json string, builder_fee double")
    got = lake.silver_fills(fill).first()
    assert (got["notional"], got["maker_side"], round(got["fee_bps"], 9)) == (200.0, 1, 5.0)
    top = lake.silver_book(spark.createDataFrame([(100.0, 2.0, 101.0, 1.0)], "bid_px double, bid_sz double, ask_px double, ask_sz double")).first()
    assert (top["mid"], round(top["microprice"], 9), round(top["top_imbalance"], 9)) == (100.5, round((100 + 202) / 3, 9), round(1 / 3, 9))


def test_out_of_fold_scores(spark):
    rows = spark.range(600).selectExpr("id", "id * 1000 AS ts_ms", "double(id % 7) AS a", "double((id * 37) % 11) AS b").withColumn("y", F.col("a") + F.col("b") / 4 > 4)
    scored = models.out_of_fold(rows, ["a", "b"], "y", 2, 5000, 5000, trees=3).cache()
    assert scored.count() == 600 and scored.select("id").distinct().count() == 600
    assert stats.auroc(scored).first()[0] > 0.95
    assert models.fit_isotonic(scored.withColumn("y", F.lit(True)), "p", "y") is None


def plain_isotonic(rows):
    """Pool adjacent violators over rows of (score, label), one by one."""
    by = {}
    for p, y in rows:
        n, t = by.get(p, (0, 0))
        by[p] = (n + 1, t + y)
    blocks = []
    for p in sorted(by):
        blocks.append([p, p, *by[p]])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
            lo, _, n, t = blocks[-2]
            blocks[-2:] = [[lo, blocks[-1][1], n + blocks[-1][2], t + blocks[-1][3]]]
    return [tuple(b) for b in blocks]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_isotonic_blocks_equal_a_plain_fit(spark, parts):
    rng = random.Random(parts)
    rows = [(p := rng.randrange(400) / 400, rng.random() < p * p) for _ in range(3000)] + [(None, True)]
    table = spark.createDataFrame(rows, "p double, y boolean")
    got = sorted(tuple(r) for r in models.isotonic_blocks(table, "p", "y", parts).collect())
    assert got == plain_isotonic([r for r in rows if r[0] is not None])
    x, y = models.fit_isotonic(table, "p", "y", parts)
    assert x == sorted(x)
    assert y == sorted(y)
    assert models.fit_isotonic(table.filter("y"), "p", "y") is None


def test_many_knots_are_looked_up(spark):
    x = [i / 200 for i in range(201)]
    y = [v * v for v in x]
    rows = spark.createDataFrame([(0.0025,), (-1.0,), (2.0,), (0.5,), (None,)], "p double")
    got = [r[0] for r in rows.select(market.interpolated(F.col("p"), x, y)).collect()]
    few = [r[0] for r in rows.select(market.interpolated(F.col("p"), x[::4], y[::4])).collect()]
    assert got[:4] == pytest.approx([0.0000125, 0.0, 1.0, 0.25])
    assert got[4] is None is few[4]
    assert few[1:4] == pytest.approx(got[1:4])
