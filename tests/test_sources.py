"""Parsers on the shapes that the archives use."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidelake.sources import exchange_csv as csv
from tidelake.sources import venue_json as venue


def lines(spark, *values):
    return spark.createDataFrame([("f", i, x) for i, x in enumerate(values)], "file string, line_no int, value string")


def test_exchange_rows(spark):
    rows = csv.data_rows(lines(spark, "id,price", "", "41,512.25,3.5,7,9,1893456000000,true", "42,512.5,0.25,10,10,1893456000001,False"))
    got = csv.agg_trades(rows, "btcusdt").orderBy("sequence").collect()
    assert [(r["agg_trade_id"], r["price"], r["is_buyer_maker"], r["sequence"], r["symbol"]) for r in got] == [(41, 512.25, True, 0, "BTCUSDT"), (42, 512.5, False, 1, "BTCUSDT")]
    assert csv.trades(csv.data_rows(lines(spark, "77,8.5,2,17,1893456000000,true")), "x").first()["side"] == "sell"
    tick = csv.book_ticker(csv.data_rows(lines(spark, "815,1,2,3,4,1893456000000", "1893456000000,1,2,3,4")), "x").select(F.unix_millis("timestamp").alias("t")).collect()
    assert [r["t"] for r in tick] == [1893456000000] * 2
    bar = csv.klines(csv.data_rows(lines(spark, "open_time,o", "1893456000000,20.5,21,19.75,20.25,7,1893456059999,141.75,9,3,60.75,0")), "x", "1m").first()
    assert (bar["close"], bar["trade_count"]) == (20.25, 9)
    depth = csv.book_depth(csv.data_rows(lines(spark, "timestamp,percentage", "2030-01-01 00:00:00,-1,10,20")), "x").select(F.unix_millis("timestamp").alias("t"), "percentage").first()
    assert tuple(depth) == (1893456000000, -1.0)


def test_zip_must_hold_one_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", "id\n1,2,3,4,5,6,true\n")
    assert csv.data_rows(csv.read_zipped_lines(spark, str(tmp_path / "a.zip"))).count() == 1
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("a.csv", "1")
        z.writestr("b.csv", "1")
    with pytest.raises(Exception, match="expected one"):
        csv.read_zipped_lines(spark, str(tmp_path / "b.zip")).collect()


def test_grid_and_coverage(spark):
    grid = csv.day_grid(spark, "2024-05-01", "2024-05-04")
    got = csv.coverage(grid, grid.filter("day <> date'2024-05-02'")).first()
    assert (got["expected"], got["present"], [str(d) for d in got["missing"]], got["ratio"]) == (4, 3, ["2024-05-02"], 0.75)
    assert csv.coverage(grid.filter("false"), grid).first()["ratio"] == 1.0
    assert csv.archive_paths(grid, "klines", "btcusdt", "1m").first()["path"].endswith("klines/BTCUSDT/1m/BTCUSDT-1m-2024-05-01.zip")


def test_book_envelopes(spark):
    bare = {"coin": "SOL", "time": 5, "levels": [[{"px": "100.0", "sz": "2.0", "n": 3}], [{"px": "101.0", "sz": "1.0", "n": 2}]]}
    texts = [bare, {"channel": "l2Book", "data": bare}, {"time": "x", "ver_num": 1, "raw": {"channel": "l2Book", "data": bare}}]
    got = venue.top_of_book(venue.l2_book(lines(spark, *map(json.dumps, texts), ""))).collect()
    assert [tuple(r) for r in got] == [("SOL", 5, 100.0, 2.0, 3, 101.0, 1.0, 2)] * 3
    with pytest.raises(Exception, match="empty side"):
        venue.top_of_book(venue.l2_book(lines(spark, json.dumps(bare | {"levels": [[], []]})))).collect()


def test_nested_fills(spark):
    fill = {"coin": "SOL", "px": "100.5", "sz": "2", "side": "buy", "time": 7, "crossed": True, "oid": 1, "tid": 2, "fee": "0.1"}
    docs = [fill, [fill, fill], {"fill": fill}, {"events": [fill]}, {"userFills": [["user", fill]]}, [["0xabc", fill | {"crossed": None}]], {"other": 1}, "text"]
    got = venue.typed_fills(venue.node_fills(lines(spark, *map(json.dumps, docs), "not json"))).collect()
    assert len(got) == 7
    assert {(r["coin"], r["px"], r["side"], r["ts_ms"], r["fee"]) for r in got} == {("SOL", 100.5, "B", 7, 0.1)}
    assert sorted(str(r["crossed"]) for r in got) == ["None"] + ["True"] * 6


def test_deeply_nested_fills(spark):
    fill = {"coin": "SOL", "px": "100.5", "sz": "2", "side": "A", "time": 7}
    docs = []
    for depth in (1, 5, 8, 13):
        doc = fill
        for i in range(depth):
            doc = [doc] if i % 2 else {"events": [doc]}
        docs.append(doc)
    assert venue.node_fills(lines(spark, *map(json.dumps, docs))).count() == 4


def test_unknown_words_are_errors(spark):
    with pytest.raises(Exception, match="unknown word for crossed"):
        venue.typed_fills(venue.node_fills(lines(spark, json.dumps({"coin": "S", "px": "1", "sz": "1", "side": "B", "time": 1, "crossed": "perhaps"})))).collect()


def test_files_of_one_document_or_of_lines(spark):
    pretty, per_line = json.dumps([{"a": 1}, {"a": 2}], indent=1), '{"a": 1}\n\n{"a": 2}\r\n'
    assert venue.json_or_lines(lines(spark, pretty, per_line)).count() == 3


def test_numbers_run_on_over_blocks(spark, tmp_path):
    """A file that Spark cuts into many blocks is numbered as a whole."""
    rows = [f"{i},{i}.5,1,1,1,{1893456000000 + i},true" for i in range(3000)]
    (tmp_path / "a.csv").write_text("id,price\r\n" + "\r\n".join(rows) + "\r\n")
    (tmp_path / "b.csv").write_text("\n".join(rows[:10]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        got = csv.parse(csv.data_rows(csv.read_lines(spark, str(tmp_path))), "aggTrades", "x")
        assert got.filter("agg_trade_id = sequence").count() == got.count() == 3010
        assert csv.read_lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError, match="interval"):
        csv.parse(got, "klines", "x")
    with pytest.raises(ValueError, match="unknown"):
        csv.parse(got, "else", "x")


def test_contexts(spark, tmp_path):
    (tmp_path / "api.csv").write_text("coin,funding,openInterest,oraclePx,markPx,midPx,premium\nSOL,0.1,5,100,101,,\n")
    (tmp_path / "archive.csv").write_text("time,coin,funding,open_interest,oracle_px,mark_px,mid_px,premium\n2030-01-01T00:00:00.123456789Z,SOL,0.1,5,100,101,102,0.5\n1893456000000,BTC,0.1,5,100,101,102,0.5\n")
    api, archive = venue.asset_contexts(spark, str(tmp_path / "api.csv")).first(), venue.asset_contexts(spark, str(tmp_path / "archive.csv")).collect()
    assert (api["mid_px"], api["premium"], api["ts_ms"]) == (101.0, 0.0, None)
    assert [r["ts_ms"] for r in archive] == [1893456000123, 1893456000000]
    reply = json.dumps([{"universe": [{"name": "A"}, {"name": "B"}]}, [{"funding": "1", "markPx": "2"}, {"funding": "3", "markPx": "4"}]])
    assert [(r["coin"], r["funding"], r["mark_px"]) for r in venue.universe_contexts(lines(spark, reply)).collect()] == [("A", 1.0, 2.0), ("B", 3.0, 4.0)]
    with pytest.raises(Exception, match="differ in length"):
        venue.universe_contexts(lines(spark, json.dumps([{"universe": [{"name": "A"}]}, []]))).collect()


def test_candles(spark):
    got = venue.candles(lines(spark, json.dumps({"s": "SOL", "i": "1m", "t": 1, "T": 2, "o": "1", "h": "3", "l": "0.5", "c": "2", "v": "9", "n": 4}))).first()
    assert (got["open_ts_ms"], got["close_ts_ms"], got["close"], got["trade_count"]) == (1, 2, 2.0, 4)
