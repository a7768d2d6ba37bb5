"""A feed over a socket that breaks, and a query that is started again."""

import json
import socket
import threading
import time

import pytest

from tidelake.sources import message_stream, resilience


class Feed:
    """Sends lines to whoever connects, each once; hangs up after every ``cut`` lines."""

    def __init__(self, lines, cut):
        self.lines, self.cut, self.sent, self.connections = lines, cut, 0, 0
        self.server = socket.create_server(("127.0.0.1", 0))
        self.port = self.server.getsockname()[1]
        threading.Thread(target=self.run, daemon=True).start()

    def run(self):
        while True:
            try:
                to, _ = self.server.accept()
            except OSError:
                return
            self.connections += 1
            with to:
                part = self.lines[self.sent : self.sent + self.cut]
                self.sent += len(part)
                to.sendall("".join(x + "\n" for x in part).encode())
                if not part:
                    time.sleep(0.2)


@pytest.fixture
def feed(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("to_json(struct(*)) as value").limit(700).collect()
    feed = Feed([r["value"] for r in rows], 100)
    yield feed
    feed.server.close()


def run(spark, feed, tmp_path, most):
    spark.dataSource.register(message_stream.MessageSource)
    options = {"host": "127.0.0.1", "port": feed.port, "spool": str(tmp_path / "spool"), "max_messages": most, "batch_messages": 150, "poll_ms": 300, "retry_ms": 10}
    query = message_stream.raw_sink(spark.readStream.format("messages").options(**options).load(), str(tmp_path / "out"), str(tmp_path / "state"), processingTime="0 seconds")
    until = time.time() + 120
    while time.time() < until and query.exception() is None:
        done = sum(p["numInputRows"] for p in query.recentProgress)
        if done and not query.status["isDataAvailable"] and spark.read.text(str(tmp_path / "out")).count() >= most:
            break
        time.sleep(0.5)
    query.stop()
    assert query.exception() is None
    return [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]


def test_every_message_once_over_breaks_and_a_restart(spark, feed, tmp_path):
    first = run(spark, feed, tmp_path, 350)
    assert sorted(first) == sorted(feed.lines[:350])
    assert feed.connections > 2
    lost = feed.sent - 350  # was under way when the query ended
    again = run(spark, feed, tmp_path, 500)
    assert len(again) == 500 == len(set(again))
    assert set(first) <= set(again) <= set(feed.lines)
    assert 0 <= lost <= 200
    assert all(json.loads(x)["event_id"] is not None for x in again)


def test_the_spool_gives_batches_again(tmp_path):
    spool = message_stream.Spool(str(tmp_path / "spool"))
    spool.write(0, ["a", "b"])
    spool.write(2, ["c"])
    spool.write(3, ["d", "e"])
    assert spool.read(1, 4) == [(1, "b"), (2, "c"), (3, "d")]
    assert spool.read(3) == [(3, "d"), (4, "e")]
    assert spool.read(5) == []


def test_retries_wait_up_to_a_growing_bound():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise OSError("down")
        return "up"

    assert resilience.retried(flaky, 5, 1.0, 3.0, sleep=waits.append, draw=lambda a, b: b) == "up"
    assert waits == [1.0, 2.0, 3.0]
    with pytest.raises(OSError, match="down"):
        resilience.retried(lambda: (_ for _ in ()).throw(OSError("down")), 2, sleep=waits.append)
    with pytest.raises(KeyError):
        resilience.retried(lambda: {}["x"], 5, sleep=waits.append)


def test_a_breaker_opens_and_lets_one_try_through():
    now = [0.0]
    breaker = resilience.Breaker(2, 10, lambda: now[0])
    fails = lambda: (_ for _ in ()).throw(OSError("down"))
    with pytest.raises(OSError, match="down"):
        resilience.retried(fails, 2, sleep=lambda s: None, breaker=breaker)
    with pytest.raises(resilience.CircuitOpen):
        resilience.retried(lambda: "up", 1, sleep=lambda s: None, breaker=breaker)
    now[0] = 11
    with pytest.raises(OSError, match="down"):
        resilience.retried(fails, 1, breaker=breaker)
    with pytest.raises(resilience.CircuitOpen):
        resilience.retried(lambda: "up", 1, breaker=breaker)
    now[0] = 22
    assert resilience.retried(lambda: "up", 1, breaker=breaker) == "up"
    assert breaker.failed == 0
