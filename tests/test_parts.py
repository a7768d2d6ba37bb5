"""How tables are cut into parts."""

from tidelake import plans
from tidelake.operators import orderflow, ordered
from tidelake.plans import adapters


def test_a_join_is_cut_by_what_its_inputs_hold(spark):
    rows = adapters.scores(spark, "/root/testdata/sf0.1")
    assert ordered.parts_for(rows) == 1  # two tables of 16 MB together


def test_feature_store_has_tasks_by_its_size_and_a_shuffle_for_each_window(spark, monkeypatch):
    orders = adapters.orders(spark, "/root/testdata/sf0.001")
    windows = {"a": 1000, "b": 60_000, "c": 3_600_000}
    plan = orderflow.feature_store(orders, windows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == len(windows)
    assert orderflow._parts_for(orders) is None
    monkeypatch.setattr(orderflow, "_STORE_BYTES", 500)
    few, many = (orderflow._parts_for(adapters.orders(spark, f"/root/testdata/sf{sf}")) for sf in ("0.001", "0.01"))
    assert 4 < few < many / 4
    assert f", {few}" in orderflow.feature_store(orders, windows)._jdf.queryExecution().optimizedPlan().toString()


def test_rules_on_the_store_shuffle_for_each_window(spark):
    plan = plans.QUERIES["q_P11_rules_on_store"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 3


def test_rules_on_the_store_sort_only_for_what_they_read(spark):
    plan = plans.QUERIES["q_P11_rules_on_store"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    by_order = [line for line in plan.splitlines() if "Window [" in line and "[scenario_id#" in line and ", order_id#" in line.rsplit("], [", 1)[0].rsplit("[", 1)[-1]]
    assert not by_order  # no rule reads how many orders are distinct
    assert sum("Window [" in line for line in plan.splitlines()) < 30


def test_feature_store_of_a_table_of_unknown_size_has_as_many_tasks_as_a_shuffle(spark):
    rows = spark.sparkContext.parallelize([(1, 2)]).toDF(["scenario_id", "ts_ms"])
    assert orderflow._parts_for(rows) is None
