"""Event-time order on a stream, and rolling state on top of it, with keyed state of bounded size.

Rows of a key wait in a sorted buffer until the key's own clock, its latest time less ``delay_ms``, has passed them.
So rows that come out of order within the delay are put in order. What comes behind the clock is late: it is routed
on, marked, to be written to a side table, or it is an error. Spark's watermark is not used, as it would drop late
rows before they can be routed.

State of a key: the buffer (rows of the last ``delay_ms``), and for rolling windows the rows of the last
``window_ms`` that have left the buffer. Both are cut at each flush, so state is bounded by the two lengths, whatever
the stream's. State lives in the state store and is restored from the checkpoint. Results don't depend on how the
stream is cut into batches, but for which rows are late; of one batch none is late to another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

#: Keyed state needs a state store that holds more than one value of a key.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_CLOCK = StructType([StructField("latest", LongType()), StructField("flushed", LongType())])


class LateRow(ValueError):
    """A row behind its key's clock, where that is an error."""


class OrderedRows(StatefulProcessor):
    """Gives each key's rows out in (ts_ms, sequence) order. Columns of the stream come as they are, key included."""

    def __init__(self, schema: StructType, delay_ms: int, strict: bool, window_ms: int | None = None, value: str | None = None, peers: bool = False):
        self.schema, self.delay_ms, self.strict, self.window_ms, self.value, self.peers = schema, delay_ms, strict, window_ms, value, peers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", _CLOCK)
        self.waiting = handle.getListState("waiting", self.schema)
        if self.window_ms is not None:
            self.recent = handle.getListState("recent", "ts_ms long, value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        new = pd.concat(list(rows))[names]
        latest, flushed = self.clock.get() if self.clock.exists() else (None, None)
        late = new["ts_ms"] <= flushed if flushed is not None else pd.Series(False, new.index)
        if late.any():
            if self.strict:
                raise LateRow(f"key {key}: a row at {int(new['ts_ms'][late].min())} comes after the rows up to {flushed} went out")
            yield self._out(new[late], True)
        held = pd.DataFrame([tuple(x) for x in self.waiting.get()], columns=names) if self.waiting.exists() else new.iloc[:0]
        held = pd.concat([x for x in (held, new[~late]) if len(x)] or [held]).sort_values(["ts_ms", "sequence"], kind="stable")
        latest = max([x for x in (latest, int(new["ts_ms"].max())) if x is not None])
        flushed = max([x for x in (flushed, latest - self.delay_ms) if x is not None])
        self.clock.update((latest, flushed))
        goes = held["ts_ms"] <= flushed
        self._keep(self.waiting, held[~goes], names)
        if goes.any():
            yield self._out(held[goes], False)

    @staticmethod
    def _keep(state: object, rows: pd.DataFrame, names: list[str]) -> None:
        if len(rows):
            plain = rows[names].astype(object)
            state.put([tuple(None if x is None or x != x else x for x in r) for r in plain.itertuples(index=False, name=None)])
        elif state.exists():
            state.clear()

    def _out(self, rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        out = rows.assign(late=late)
        if self.window_ms is None:
            return out
        if late:  # a late row counts in no window
            return out.assign(n=pd.array([None] * len(out), "Int64"), total=np.nan, held=pd.array([None] * len(out), "Int64"))
        recent = pd.DataFrame([tuple(x) for x in self.recent.get()], columns=["ts_ms", "value"]) if self.recent.exists() else pd.DataFrame({"ts_ms": [], "value": []})
        ts = np.concatenate([recent["ts_ms"].to_numpy(np.int64), rows["ts_ms"].to_numpy(np.int64)])
        value = np.concatenate([recent["value"].to_numpy(np.float64), rows[self.value].fillna(0).to_numpy(np.float64)])
        upto = np.append(0.0, np.cumsum(value))
        at = np.arange(len(recent), len(ts))
        first = np.searchsorted(ts, ts[at] - self.window_ms)
        end = np.searchsorted(ts, ts[at], side="right") if self.peers else at + 1  # rows of one time leave the buffer together
        stays = ts >= ts[-1] - self.window_ms  # later rows see nothing before
        self._keep(self.recent, pd.DataFrame({"ts_ms": ts[stays], "value": value[stays]}), ["ts_ms", "value"])
        return out.assign(n=end - first, total=upto[end] - upto[first], held=int(stays.sum()))

    def close(self) -> None:
        pass


def _transformed(stream: DataFrame, key: str, processor: OrderedRows, more: list[StructField]) -> DataFrame:
    schema = StructType([*stream.schema.fields, StructField("late", BooleanType()), *more])
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "None")


def in_order(stream: DataFrame, key: str, delay_ms: int, strict: bool = False) -> DataFrame:
    """A stream with ts_ms and sequence, each key's rows in their order, and ``late``. ``strict``: a late row ends the query with an error."""
    return _transformed(stream, key, OrderedRows(stream.schema, delay_ms, strict), [])


def rolling_state(stream: DataFrame, key: str, value: str, window_ms: int, delay_ms: int, peers: bool = False) -> DataFrame:
    """For each row in order ``n`` and ``total`` (of ``value``) of the closed window before it, and ``held``, the window rows in state afterwards.

    Equal to ``temporal.rolling_sums`` over the same rows, with or without ``peers``. Late rows have nulls.
    """
    more = [StructField("n", LongType()), StructField("total", DoubleType()), StructField("held", LongType())]
    return _transformed(stream, key, OrderedRows(stream.schema, delay_ms, False, window_ms, value, peers), more)


def routed(rows: DataFrame, main: str, side: str):
    """Writes a stream with ``late`` to two folders of Parquet: a function for foreachBatch, safe to repeat.

    A batch is written under its number, and overwrites what a failed attempt left there.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for late, path in ((False, main), (True, side)):
            batch.filter("late" if late else "not late").drop("late").write.mode("overwrite").parquet(f"{path}/batch={epoch}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(write)
