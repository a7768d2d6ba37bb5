"""An unbounded source: messages, one a line, from a socket that may break at any time.

The reader connects again with growing, jittered pauses; behind a breaker it reports no messages instead of failing
the query. A socket can't be asked again for what it has sent, so every batch is written to a spool of JSON lines in
the shared folder before it counts, under its first offset. A batch that Spark asks for again, also after a restart,
comes from the spool. So each message that was received is delivered once; what the far side sends while nobody
listens is lost, as with any such feed.

    spark.dataSource.register(MessageSource)
    spark.readStream.format("messages").option("host", ...).option("port", ...).option("spool", ...).load()

``max_messages`` ends the source after so many; ``batch_messages`` and ``poll_ms`` bound a batch.
"""

from __future__ import annotations

import json
import socket
import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from tidelake.sources.resilience import Breaker, retried


class Spool:
    """Batches of messages as files of JSON lines, named by the first message's offset."""

    def __init__(self, path: str):
        self.store, self.root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.store.create_dir(self.root, recursive=True)

    def starts(self) -> list[int]:
        found = self.store.get_file_info(fs.FileSelector(self.root))
        return sorted(int(f.base_name.removesuffix(".jsonl")) for f in found if f.base_name.endswith(".jsonl"))

    def write(self, start: int, messages: list[str]) -> None:
        staged = f"{self.root}/{start:020d}.tmp"
        with self.store.open_output_stream(staged, compression=None) as out:
            out.write("".join(json.dumps({"offset": start + k, "value": m}) + "\n" for k, m in enumerate(messages)).encode())
        self.store.move(staged, f"{self.root}/{start:020d}.jsonl")

    def read(self, start: int, end: int | None = None) -> list[tuple[int, str]]:
        """Messages from ``start`` on, before ``end``."""
        out = []
        starts = self.starts()
        for k, first in enumerate(starts):
            if (end is not None and first >= end) or (k + 1 < len(starts) and starts[k + 1] <= start):
                continue
            with self.store.open_input_stream(f"{self.root}/{first:020d}.jsonl", compression=None) as f:
                rows = [json.loads(x) for x in f.read().decode().splitlines()]
            out += [(r["offset"], r["value"]) for r in rows if r["offset"] >= start and (end is None or r["offset"] < end)]
        return out


class MessageReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.host, self.port = options["host"], int(options["port"])
        self.spool_path, self.most = options["spool"], int(options.get("max_messages", -1))
        self.batch, self.poll_s = int(options.get("batch_messages", 10_000)), int(options.get("poll_ms", 500)) / 1000
        self.tries, self.base_s = int(options.get("tries", 4)), int(options.get("retry_ms", 200)) / 1000
        self.breaker = Breaker(int(options.get("breaker_failures", 8)), int(options.get("breaker_pause_ms", 30_000)) / 1000)
        self.lines, self.rest = None, b""

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def _connect(self) -> socket.socket:
        return socket.create_connection((self.host, self.port), timeout=self.poll_s)

    def _received(self, room: int) -> list[str]:
        """What comes within the poll time; a broken connection is opened again."""
        out: list[str] = []
        until = time.monotonic() + self.poll_s
        while len(out) < room and time.monotonic() < until:
            try:
                if self.lines is None:
                    self.lines, self.rest = retried(self._connect, self.tries, self.base_s, breaker=self.breaker), b""
                data = self.lines.recv(1 << 16)
            except TimeoutError:
                break
            except OSError:
                self.lines = None
                break  # the next batch tries again
            if not data:  # the far side has closed; an unfinished line is none
                self.lines.close()
                self.lines = None
                continue
            *whole, self.rest = (self.rest + data).split(b"\n")
            out += [x.decode("utf-8", "replace") for x in whole if x.strip()]
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at, spool = start["offset"], Spool(self.spool_path)
        rows = spool.read(at)  # received before, but not yet part of a batch
        room = self.batch if self.most < 0 else min(self.batch, self.most - at)
        if not rows and room > 0:
            new = self._received(room)
            if self.most >= 0:
                new = new[: self.most - at]
            if new:
                spool.write(at, new)
                rows = [(at + k, m) for k, m in enumerate(new)]
        return iter(rows), {"offset": at + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(Spool(self.spool_path).read(start["offset"], end["offset"]))


class MessageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "messages"

    def schema(self) -> str:
        return "offset bigint, value string"

    def simpleStreamReader(self, schema: object) -> MessageReader:
        return MessageReader(self.options)


def raw_sink(messages: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Messages as lines of text, as they came. The sink's own log lists the files of finished batches, so none counts twice."""
    return messages.select("value").writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
