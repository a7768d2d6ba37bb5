"""Tables that change together: upserts into several of them become visible at once, or not at all.

Rows of a table lie in buckets by their key's hash. A commit rewrites the buckets that it touches, into new folders;
then one small manifest, numbered one above the last, names the folders of every table. Readers go by a manifest, so
they see all tables of one snapshot, and a job that dies on the way leaves the old one. The manifest's file is
renamed into place only where none of its number is there (atomic on HDFS and stores with conditional renames), so of
two writers one wins, and the other starts again from the winner's snapshot.

The epoch of a stream's batch is kept in the manifest of its commit, so a batch that is delivered twice counts once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer's commit came first, more often than was to be tried."""


@dataclass
class Upsert:
    """Rows for a table. Of rows alike in ``keys`` the largest by ``order`` stays; of equal ones the new one."""

    rows: DataFrame
    keys: list[str]
    order: list[str] = field(default_factory=list)


class Snapshots:
    """``buckets`` is of tables that a commit makes; choose it so that a bucket is some hundred MB."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path, self._conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # the log

    def versions(self) -> list[int]:
        log = self._path(f"{self.root}/log")
        names = [s.getPath().getName() for s in self._fs.listStatus(log)] if self._fs.exists(log) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self) -> int:
        """The newest snapshot's number; 0 where nothing is committed."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"tables": {}, "streams": {}}
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.root}/log/{version:020d}.json").collect()))

    def _put(self, version: int, manifest: dict) -> bool:
        """Whether the manifest is in place now; no if there is one of its number."""
        jvm, staged = self.spark.sparkContext._jvm, self._path(f"{self.root}/log/_{uuid.uuid4().hex}")
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), self._conf)
        plainly = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(files.makeQualified(staged), files.makeQualified(self._path(f"{self.root}/log/{version:020d}.json")), plainly)
        except Py4JJavaError as e:
            self._fs.delete(staged, False)
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            return False
        return True

    # tables

    def _bucket(self, keys: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _stored(self, table: dict, of: set[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/{folder}/_bucket={b}" for b, folder in table["folders"].items() if of is None or int(b) in of]
        schema = StructType.fromJson(table["schema"])
        return self.spark.read.schema(schema).parquet(*paths).select(schema.names) if paths else self.spark.createDataFrame([], schema)

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self._manifest(self.version() if version is None else version)["tables"])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table of the newest snapshot, or of an earlier one."""
        found = self._manifest(self.version() if version is None else version)["tables"]
        if table not in found:
            raise KeyError(f"no table {table} in {sorted(found)}")
        return self._stored(found[table])

    def _staged(self, name: str, change: Upsert, buckets: int) -> tuple[str, set[int]]:
        """Writes the new rows once, by bucket: where, and which buckets they touch."""
        folder = f"staging/{name}-{uuid.uuid4().hex}"
        dealt = change.rows.withColumn("_bucket", self._bucket(change.keys, buckets))
        dealt.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))]
        return folder, {int(n.removeprefix("_bucket=")) for n in names if n.startswith("_bucket=")}

    def _merged(self, name: str, change: Upsert, table: dict | None, folder: str, touched: set[int]) -> dict:
        """The table's entry with the touched buckets rewritten."""
        schema = change.rows.schema
        new = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}").select(schema.names).withColumn("_new", F.lit(1))
        table = table or {"keys": change.keys, "buckets": self.buckets, "folders": {}, "schema": json.loads(schema.json())}
        if table["keys"] != change.keys:
            raise ValueError(f"{name} is keyed by {table['keys']}, not by {change.keys}")
        both = self._stored(table, touched).withColumn("_new", F.lit(0)).unionByName(new, allowMissingColumns=True)
        columns = [c for c in both.columns if c != "_new"]
        best = both.groupBy(*change.keys).agg(F.max_by(F.struct(*columns), F.struct(*change.order, "_new", F.struct(*columns))).alias("row")).select("row.*")
        into = f"data/{name}-{uuid.uuid4().hex}"
        dealt = best.withColumn("_bucket", self._bucket(change.keys, table["buckets"]))
        dealt.repartition("_bucket").write.option("compression", "zstd").partitionBy("_bucket").parquet(f"{self.root}/{into}")
        return table | {"folders": table["folders"] | {str(b): into for b in touched}, "schema": json.loads(best.schema.json())}

    def commit(self, changes: dict[str, Upsert], stream: tuple[str, int] | None = None, tries: int = 5) -> int:
        """All changes as one new snapshot; its number. With ``stream`` (name, epoch), nothing where that epoch is in already."""
        staged: dict[str, tuple[str, set[int], int]] = {}
        try:
            for _ in range(tries):
                base = self.version()
                now = self._manifest(base)
                if stream and now["streams"].get(stream[0], -1) >= stream[1]:
                    return base
                tables = dict(now["tables"])
                for name, change in changes.items():
                    buckets = tables[name]["buckets"] if name in tables else self.buckets
                    if name not in staged or staged[name][2] != buckets:
                        staged[name] = (*self._staged(name, change, buckets), buckets)
                    tables[name] = self._merged(name, change, tables.get(name), *staged[name][:2])
                streams = now["streams"] | ({stream[0]: stream[1]} if stream else {})
                if self._put(base + 1, {"tables": tables, "streams": streams}):
                    return base + 1
            raise Conflict(f"{tries} times another writer came first")
        finally:
            for folder, *_ in staged.values():
                self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def vacuum(self, keep: int = 10) -> int:
        """Forgets all but the newest ``keep`` snapshots, and deletes folders that no kept one names; how many. Not beside a running writer."""
        versions = self.versions()
        named = {f for v in versions[-keep:] for t in self._manifest(v)["tables"].values() for f in t["folders"].values()}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/log/{v:020d}.json"), False)
        data = self._path(f"{self.root}/data")
        old = [s.getPath() for s in self._fs.listStatus(data) if f"data/{s.getPath().getName()}" not in named] if self._fs.exists(data) else []
        for path in old:
            self._fs.delete(path, True)
        return len(old)

    def sink(self, name: str, changes: Callable[[DataFrame], dict[str, Upsert]]) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function: each batch's changes are one snapshot, once. ``name`` stands for the query's checkpoint."""

        def write(batch: DataFrame, epoch: int) -> None:
            Snapshots(batch.sparkSession, self.root, self.buckets).commit(changes(batch), (name, epoch))

        return write
