"""Queries against their SQL on events of equal times and on fills without size, which the small driver tables lack."""

import duckdb
import pytest

from tidelake import plans


def same(spark, folder, name, events, numbers=None, settings=None):
    """The query's rows, which must be its SQL's; ``events``: (seconds, user_id, event_type, value, k), numbered as they come or by ``numbers``."""
    con = duckdb.connect(config=settings or {})
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, make_timestamp(?), ?, ?, ?, ?)", [(i, round(s * 1_000_000), user, kind, value, k if k is None else f'{{"k": {k}}}') for i, (s, user, kind, value, k) in zip(numbers or range(len(events)), events, strict=True)])
    con.execute(f"COPY events TO '{folder}/events.parquet'")
    df, want = plans.QUERIES[name](spark, str(folder)), con.sql(plans.ORACLES[name])
    columns, rows = want.columns, want.fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, rows))
    return {r[0]: r[1:] for r in got}


#: A fill, and two quotes an hour later at one time, the dearer one first.
_TWO_MIDS = [(0, 0, "purchase", 5.0, 0), (3600, 0, "view", 1.0, 6), (3600, 0, "view", 1.0, 0)]


def test_markout_takes_the_first_of_quotes_of_one_time(spark, tmp_path):
    found = same(spark, tmp_path, "q_J04_markout_forward", _TWO_MIDS)
    assert found[0][0] == -325.0  # by the first quote, whose mid is 103.25


def test_markouts_of_horizons_take_the_first_of_quotes_of_one_time(spark, tmp_path):
    found = same(spark, tmp_path, "q_J05_markout_horizons", [*_TWO_MIDS, (6 * 3600, 0, "view", 1.0, 6), (6 * 3600, 0, "view", 1.0, 0)])
    assert found[0][0] == found[0][2] == -325.0


#: Quotes of one millisecond but not of one time, the later one with the smaller number: before the fill (both), and at each horizon.
_ONE_MS = [(0, 0, "view", 1.0, 0), (0.0001, 0, "view", 1.0, 6), (0.001, 0, "purchase", 5.0, 0), *[(h * 3600 + s, 0, "view", 1.0, k) for h in (1, 6, 24) for s, k in ((0.001, 6), (0.0015, 0))]]
_ONE_MS_NUMBERS = [9, 8, 0, 7, 6, 5, 4, 3, 2]


@pytest.mark.parametrize("name", ["q_J04_markout_forward", "q_J05_markout_horizons", "q_K08_horizons"])
def test_markouts_take_the_first_quote_within_a_millisecond(spark, tmp_path, name):
    found = same(spark, tmp_path, name, _ONE_MS, _ONE_MS_NUMBERS)
    assert {x for x in found[0] if not isinstance(x, bool)} == {-325.0}


@pytest.mark.parametrize("name", ["q_J01_asof_backward", "q_J03_training_rows", "q_J08_top_of_book_matching", "q_P04_feature_vector", "q_P06_markout_bps", "q_V25_rebuilt_training_rows"])
def test_as_of_joins_take_the_last_quote_within_a_millisecond(spark, tmp_path, name):
    # as DuckDB joins tables of more than a few rows: by sorting
    context = [(0, 0, "signup", 1.0, 0), (0.0001, 0, "signup", 2.0, 6)]
    same(spark, tmp_path, name, context + _ONE_MS, [19, 18, *_ONE_MS_NUMBERS], {"asof_loop_join_threshold": 0})


def test_a_fill_whose_quotes_are_all_without_price_is_not_labelled(spark, tmp_path):
    assert same(spark, tmp_path, "q_J05_markout_horizons", [(0, 0, "purchase", 5.0, 0), (90_000, 0, "view", 1.0, None)]) == {}


def test_fee_of_fills_without_size(spark, tmp_path):
    quote = (0, 0, "view", 1.0, 0)
    found = same(spark, tmp_path, "q_P04_feature_vector", [quote, (1, 0, "purchase", 0.0, 0), (2, 0, "purchase", None, 0), (3, 0, "purchase", -2.0, 0), (4, 0, "purchase", 2.0, 0)])
    assert found[1][2] != found[1][2] and found[2][2] is None  # not a number, not known


#: Orders of one scenario, two of them at one time.
_PEERS = [(0, 0, "view", 1000.0, 0), (60, 0, "click", 2000.0, 1), (60, 20, "purchase", 4000.0, 2), (3660, 0, "view", 8000.0, 3)]


def test_rolling_window_holds_all_orders_of_its_time(spark, tmp_path):
    found = same(spark, tmp_path, "q_W01_rolling_window", _PEERS)
    assert found == {0: (1, 1.0), 1: (3, 7.0), 2: (3, 7.0), 3: (3, 14.0)}


def test_rolling_imbalance_holds_all_quotes_of_its_time(spark, tmp_path):
    found = same(spark, tmp_path, "q_W04_ofi_rolling", [(0, 0, "view", 1.0, 0), (60, 0, "view", 1.0, 3), (60, 5, "view", 1.0, 5), (3660, 0, "view", 1.0, 1)])
    assert found[1] == found[2]


def test_rolling_state_holds_all_orders_of_its_time(spark, tmp_path):
    found = same(spark, tmp_path, "q_X03_rolling_state", [*_PEERS, (9000, 0, "view", 1.0, 0)])
    assert found == {0: (1, 1.0), 1: (3, 7.0), 2: (3, 7.0), 3: (3, 14.0)}
