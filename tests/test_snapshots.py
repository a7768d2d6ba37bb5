"""Snapshots of several tables: all or nothing, one winner, every batch once."""

import pytest
from pyspark.sql import functions as F

from tidelake.operators import snapshots
from tidelake.operators.snapshots import Snapshots, Upsert

CASES, LINKS = "id long, at long, state string", "case_id long, alert_id long"


@pytest.fixture
def store(spark, tmp_path):
    return Snapshots(spark, str(tmp_path / "store"), buckets=4)


def changes(spark, cases, links):
    return {"cases": Upsert(spark.createDataFrame(cases, CASES), ["id"], ["at"]), "links": Upsert(spark.createDataFrame(links, LINKS), ["case_id", "alert_id"])}


def rows(store, table, version=None):
    return sorted(map(tuple, store.read(table, version).collect()))


def test_upserts_of_two_tables_are_one_snapshot(spark, store):
    assert (store.version(), store.tables()) == (0, [])
    assert store.commit(changes(spark, [(1, 1, "open"), (2, 5, "open")], [(1, 10)])) == 1
    assert store.commit(changes(spark, [(1, 2, "closed"), (2, 4, "old"), (3, 1, "open"), (3, 3, "shut")], [(1, 10), (3, 11)])) == 2
    assert rows(store, "cases") == [(1, 2, "closed"), (2, 5, "open"), (3, 3, "shut")]
    assert rows(store, "links") == [(1, 10), (3, 11)]
    assert rows(store, "cases", 1) == [(1, 1, "open"), (2, 5, "open")]
    assert rows(store, "links", 1) == [(1, 10)]
    with pytest.raises(KeyError, match="no table x"):
        store.read("x")


def test_a_job_killed_between_tables_leaves_the_old_snapshot(spark, store):
    store.commit(changes(spark, [(1, 1, "open")], [(1, 10)]))
    broken = changes(spark, [(1, 2, "closed")], [(2, 20)])
    broken["links"].rows = broken["links"].rows.withColumn("alert_id", F.raise_error(F.lit("killed")).cast("long"))
    with pytest.raises(Exception, match="killed"):
        store.commit(broken)
    assert store.version() == 1
    assert rows(store, "cases") == [(1, 1, "open")]
    assert store.commit(changes(spark, [(1, 2, "closed")], [(2, 20)])) == 2
    assert rows(store, "cases") == [(1, 2, "closed")]
    assert store.vacuum(keep=1) >= 1
    assert (rows(store, "cases"), rows(store, "links")) == ([(1, 2, "closed")], [(1, 10), (2, 20)])


def test_of_two_writers_both_changes_stay(spark, store, monkeypatch):
    store.commit(changes(spark, [(1, 1, "open")], []))
    put, seen = Snapshots._put, []

    def slow(self, version, manifest):
        if not seen:  # another writer's commit comes in between
            seen.append(version)
            Snapshots(spark, self.root).commit(changes(spark, [(2, 1, "other")], [(2, 2)]))
        return put(self, version, manifest)

    monkeypatch.setattr(Snapshots, "_put", slow)
    assert store.commit(changes(spark, [(1, 2, "mine")], [(1, 1)])) == 3
    assert rows(store, "cases") == [(1, 2, "mine"), (2, 1, "other")]
    assert rows(store, "links") == [(1, 1), (2, 2)]
    monkeypatch.setattr(Snapshots, "_put", lambda *a: False)
    with pytest.raises(snapshots.Conflict):
        store.commit(changes(spark, [(1, 3, "late")], []))
    assert store.version() == 3


def test_a_batch_delivered_twice_counts_once(spark, store):
    write = store.sink("alerts", lambda b: {"cases": Upsert(b, ["id"], ["at"])})
    batch = spark.createDataFrame([(1, 1, "open")], CASES)
    write(batch, 0)
    write(batch, 0)
    write(spark.createDataFrame([(1, 9, "later"), (None, 1, "no id")], CASES), 7)  # epochs may be skipped
    write(spark.createDataFrame([(1, 99, "again")], CASES), 7)
    assert store.version() == 2
    assert set(map(tuple, store.read("cases").collect())) == {(1, 9, "later"), (None, 1, "no id")}


def test_new_columns_and_only_touched_buckets(spark, store):
    store.commit({"t": Upsert(spark.range(100).select("id", F.lit(1).alias("x")), ["id"])})
    before = store._manifest(1)["tables"]["t"]["folders"]
    store.commit({"t": Upsert(spark.createDataFrame([(7, 2, "new")], "id long, x int, y string"), ["id"])})
    after = store._manifest(2)["tables"]["t"]["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert store.read("t").count() == 100
    assert tuple(store.read("t").filter("id = 7").first()) == (7, 2, "new")
    with pytest.raises(ValueError, match="keyed by"):
        store.commit({"t": Upsert(spark.range(1).select("id", F.lit(1).alias("x")), ["x"])})
