"""Archive objects and the incremental build of a dataset."""

import json
import zipfile

import pyarrow as pa
import pytest

from tidelake.operators import ingest
from tidelake.operators.snapshots import Snapshots
from tidelake.sources import archive_objects


def frame(text, path):
    path.parent.mkdir(parents=True, exist_ok=True)
    with pa.CompressedOutputStream(str(path), "lz4") as f:
        f.write(text.encode())


def book(coin, at, bid):
    return json.dumps({"raw": {"data": {"coin": coin, "time": at, "levels": [[{"px": str(bid), "sz": "1", "n": 1}], [{"px": str(bid + 1), "sz": "2", "n": 1}]]}}})


def test_objects_are_read_back_line_by_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive_objects, "BLOCK_BYTES", 1000)
    lines = [book("SOL", k, 100 + k % 7) for k in range(3000)]
    frame("\n".join(lines[:2000]) + "\n", tmp_path / "in/7/l2Book/SOL.lz4")
    frame("\r\n".join(lines[2000:]), tmp_path / "in/8/l2Book/SOL.lz4")
    frame("", tmp_path / "in/9/l2Book/SOL.lz4")
    got = archive_objects.read_objects(spark, str(tmp_path / "in"))
    assert sorted(r["value"] for r in got.collect()) == sorted(lines)
    assert got.filter("object like '%/8/%'").agg({"line_no": "max"}).first()[0] == 999
    books = archive_objects.load_books(spark, str(tmp_path / "in"))
    assert books.count() == 3000
    assert books.selectExpr("sum(bids[0].px)").first()[0] == sum(100 + k % 7 for k in range(3000))


def test_written_objects_read_back_equal(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("concat('market/', event_type, '.lz4') as object", "event_id as line_no", "to_json(struct(*)) as value")
    written = {r["object"]: r["n_lines"] for r in archive_objects.write_objects(rows, str(tmp_path)).collect()}
    assert sum(written.values()) == rows.count()
    back = archive_objects.read_objects(spark, str(tmp_path))
    assert sorted((r["object"].rpartition("/")[2], r["value"]) for r in back.collect()) == sorted((r["object"].rpartition("/")[2], r["value"]) for r in rows.collect())


def test_broken_objects_are_named(spark, tmp_path):
    frame("\n".join(book("SOL", k, 100) for k in range(20_000)), tmp_path / "good.lz4")
    whole = (tmp_path / "good.lz4").read_bytes()
    (tmp_path / "short.lz4").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "text.lz4").write_bytes(b"plain text")
    with pytest.raises(Exception, match="text.lz4: not an LZ4 frame|short.lz4"):
        archive_objects.read_objects(spark, str(tmp_path)).collect()
    got = archive_objects.read_objects(spark, str(tmp_path), strict=False)
    assert {r["object"].rpartition("/")[2] for r in got.filter("broken is not null").collect()} == {"short.lz4", "text.lz4"}
    assert got.filter("object like '%good%'").count() == 20_000


def test_contexts_and_fills_of_objects(spark, tmp_path):
    frame("coin,funding,openInterest,oraclePx,markPx,midPx,premium\nSOL,0.1,5,100,101,,\n", tmp_path / "ctx/a.csv.lz4")
    frame("time,coin,funding,open_interest,oracle_px,mark_px,mid_px,premium\n2030-05-01T00:00:00.5Z,BTC,0.2,6,100,101,102,0.5\n", tmp_path / "ctx/b.csv.lz4")
    got = {r["coin"]: r for r in archive_objects.load_contexts(spark, str(tmp_path / "ctx")).collect()}
    assert (got["SOL"]["mid_px"], got["SOL"]["premium"], got["SOL"]["ts_ms"], got["SOL"]["open_interest"]) == (101.0, 0.0, None, 5.0)
    assert (got["BTC"]["mid_px"], got["BTC"]["ts_ms"]) == (102.0, 1903824000500)
    frame(json.dumps({"events": [["u", {"coin": "SOL", "px": "1", "sz": "2", "side": "B", "time": 5, "tid": 9}]]}) + "\n", tmp_path / "fills/x.lz4")
    assert [(r["coin"], r["tid"]) for r in archive_objects.load_fills(spark, str(tmp_path / "fills")).collect()] == [("SOL", 9)]


def trades(day, n, first=0):
    at = 1_893_456_000_000 + day * 86_400_000
    return "id,price,qty,first,last,time,maker\n" + "".join(f"{first + k},{100 + k}.5,1.5,{k},{k},{at + k * 1000},{'true' if k % 2 else 'false'}\n" for k in range(n))


def test_each_file_is_taken_in_once(spark, tmp_path):
    folder = tmp_path / "in/aggTrades/XYZ"
    folder.mkdir(parents=True)
    (folder / "d0.csv").write_text(trades(0, 50))
    with zipfile.ZipFile(folder / "d1.zip", "w") as z:
        z.writestr("d1.csv", trades(1, 30, 50))
    store = Snapshots(spark, str(tmp_path / "store"))
    build = lambda: ingest.ingest(spark, str(tmp_path / "in"), store, str(tmp_path / "state"), "aggTrades", "xyz")
    assert build() == 1
    assert store.read("aggTrades").count() == 80
    assert {r["path"].rpartition("/")[2]: (r["rows"], r["symbol"]) for r in store.read("files").collect()} == {"d0.csv": (50, "XYZ"), "d1.zip": (30, "XYZ")}
    assert build() == 1  # nothing new, nothing added
    (folder / "d3.csv").write_text(trades(3, 20, 80))
    assert build() == 2
    assert store.read("aggTrades").count() == 100
    assert store.read("aggTrades").selectExpr("count(distinct agg_trade_id)").first()[0] == 100
    covered = ingest.coverage(store, "aggTrades", "2030-01-01", "2030-01-04").first()
    assert (covered["expected"], covered["present"], [str(d) for d in covered["missing"]]) == (4, 3, ["2030-01-03"])


def test_a_bad_file_leaves_the_store_as_it_was(spark, tmp_path):
    folder = tmp_path / "in/aggTrades/XYZ"
    folder.mkdir(parents=True)
    (folder / "d0.csv").write_text(trades(0, 5))
    store = Snapshots(spark, str(tmp_path / "store"))
    build = lambda: ingest.ingest(spark, str(tmp_path / "in"), store, str(tmp_path / "state"), "aggTrades", "XYZ")
    build()
    with zipfile.ZipFile(folder / "two.zip", "w") as z:
        z.writestr("a.csv", trades(1, 5))
        z.writestr("b.csv", trades(2, 5))
    (folder / "d1.csv").write_text(trades(1, 7))
    with pytest.raises(Exception, match="expected one .csv, found 2"):
        build()
    assert store.version() == 1
    (folder / "two.zip").unlink()
    with zipfile.ZipFile(folder / "two.zip", "w") as z:
        z.writestr("a.csv", trades(2, 9))
    assert build() == 2
    assert store.read("aggTrades").count() == 21
