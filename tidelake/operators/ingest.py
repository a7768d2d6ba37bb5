"""Incremental build of a dataset from archive files: each file is parsed once, however often the build runs.

A file-source stream finds the files (Spark's checkpoint knows those that were seen), in batches of a bounded number.
A batch's files are parsed by the archive's parsers and become one snapshot: rows by file and place, and a record of
every file with its hash, size and rows. So a build that dies leaves no half file, and one that is run again over the
same folder adds nothing. Manifest and coverage are read from the records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.operators.snapshots import Snapshots, Upsert
from tidelake.sources import exchange_csv

#: Files of a batch: what the driver lists at once.
FILES_PER_BATCH = 200

_FILES = "path string, modificationTime timestamp, length long, content binary"


def folder_of(source: str, dataset: str, symbol: str, interval: str | None) -> str:
    return "/".join([source.rstrip("/"), dataset, symbol.upper(), *([interval] if interval else [])])


def _changes(spark: SparkSession, files: DataFrame, dataset: str, symbol: str, interval: str | None) -> dict[str, Upsert]:
    found = [r["path"] for r in files.select("path").collect()]  # at most a batch's files
    zipped = [f for f in found if f.lower().endswith(".zip")]
    plain = [f for f in found if not f.lower().endswith(".zip")]
    parsed = None
    for paths, read in ((plain, exchange_csv.read_lines), (zipped, exchange_csv.read_zipped_lines)):
        if paths:
            rows = exchange_csv.parse(exchange_csv.data_rows(read(spark, paths)), dataset, symbol, interval, keep=["file"])
            parsed = rows if parsed is None else parsed.unionByName(rows)
    counts = parsed.groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("rows"), F.min(F.to_date("timestamp")).alias("first_day"), F.max(F.to_date("timestamp")).alias("last_day"))
    contents = spark.read.format("binaryFile").load(found).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    records = contents.join(counts, "path", "left").withColumns({"dataset": F.lit(dataset), "symbol": F.lit(symbol.upper())}).fillna({"rows": 0})
    return {dataset: Upsert(parsed, ["file", "sequence"]), "files": Upsert(records, ["path"])}


def ingest(spark: SparkSession, source: str, store: Snapshots, checkpoint: str, dataset: str, symbol: str, interval: str | None = None) -> int:
    """Takes in what is new below the dataset's folder, and ends; the store's version afterwards."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", FILES_PER_BATCH)
    new = files.load(folder_of(source, dataset, symbol, interval)).select("path", "length")
    name = f"{dataset}/{symbol.upper()}/{interval or ''}"

    def write(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            store.commit(_changes(batch.sparkSession, batch, dataset, symbol, interval), (name, epoch))

    query = new.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint.rstrip('/')}/{name.rstrip('/')}").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return store.version()


def coverage(store: Snapshots, dataset: str, start: str, end: str) -> DataFrame:
    """Of the days from ``start`` to ``end`` those with rows and those without, and the ratio."""
    days = store.read(dataset).select(F.to_date("timestamp").alias("day")).distinct()
    return exchange_csv.coverage(exchange_csv.day_grid(store.spark, start, end), days)
