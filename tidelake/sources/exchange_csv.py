"""Exchange archive CSVs. Columns go by position; a header row (first cell id, timestamp or open_time) and blank lines are skipped.

``sequence`` numbers data rows within their file. Spark splits large files into blocks; rows are numbered within
their block, and start after the rows of the file's earlier blocks, so that no file is one task's.
"""

from __future__ import annotations

import io
import itertools
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADERS = ("id", "timestamp", "open_time")


def _cell(i: int) -> Column:
    return F.trim(F.get("cells", F.lit(i)))


def _ms(i: int) -> Column:
    return F.timestamp_millis(_cell(i).cast("long"))


def _double(i: int) -> Column:
    return _cell(i).cast("double")


def data_rows(lines: DataFrame) -> DataFrame:
    """Cells of the data rows, from (file, line_no, value), and block where files come in blocks."""
    block = F.col("block") if "block" in lines.columns else F.lit(0).cast("long")
    rows = lines.filter(F.trim("value") != "").select("file", block.alias("block"), "line_no", F.split("value", ",").alias("cells"))
    return rows.filter(~F.lower(_cell(0)).isin(*HEADERS))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files: (file, block, line_no, value). line_no grows within a block, and blocks grow within a file."""
    meta = "_metadata.file_path AS file", "_metadata.file_block_start AS block"
    return spark.read.text(path).selectExpr(*meta, "monotonically_increasing_id() AS line_no", "rtrim('\r', value) AS value")


#: Lines of a zipped file that are passed on at once.
LINES_PER_BATCH = 50_000


def read_zipped_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of zip files, each of which must hold exactly one .csv."""

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    members = [m for m in z.namelist() if m.lower().endswith(".csv")]
                    if len(members) != 1:
                        raise ValueError(f"{name}: expected one .csv, found {len(members)}")
                    with io.TextIOWrapper(z.open(members[0]), encoding="utf-8") as lines:
                        for start in itertools.count(0, LINES_PER_BATCH):
                            some = [x.rstrip("\r\n") for x in itertools.islice(lines, LINES_PER_BATCH)]
                            if not some:
                                break
                            yield pd.DataFrame({"file": name, "line_no": range(start, start + len(some)), "value": some})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unzip, "file string, line_no int, value string")


def write_zipped(lines: DataFrame, path: str) -> DataFrame:
    """Lines (value, in order of line_no) as zips of one CSV below ``path``, one for each ``object``: (object, n_lines) when run.

    ``path`` is of a store that pyarrow can open. A zip is held by its task until it is whole, and then moved into place.
    """
    dealt = lines.select("object", F.col("line_no").cast("long"), "value").repartition("object").sortWithinPartitions("object", "line_no")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        store.create_dir(root, recursive=True)
        rows = (r for batch in batches for r in zip(batch["object"], batch["value"], strict=True))
        for name, own in itertools.groupby(rows, key=lambda r: r[0]):
            content, n = io.BytesIO(), 0
            with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as z, z.open(f"{name.rpartition('.')[0]}.csv", "w") as member:
                for n, (_, value) in enumerate(own, 1):
                    member.write(f"{value}\n".encode())
            staged = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(staged, compression=None) as out:
                out.write(content.getbuffer())
            store.move(staged, f"{root}/{name}")
            yield pd.DataFrame({"object": [name], "n_lines": [n]})

    return dealt.mapInPandas(write, "object string, n_lines long")


def _numbered(rows: DataFrame) -> DataFrame:
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over blocks, not rows
    before = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = rows.withColumn("nth", F.row_number().over(Window.partitionBy("file", "block").orderBy("line_no")))
    return within.join(before.hint("merge"), ["file", "block"]).withColumn("sequence", (F.col("before") + F.col("nth") - 1).cast("long")).drop("before", "nth")


def parse(rows: DataFrame, dataset: str, symbol: str, interval: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows of one dataset, by its name in the archive. ``keep``: columns of the lines that stay, such as the file."""
    parsers = {"aggTrades": agg_trades, "trades": trades, "bookTicker": book_ticker, "bookDepth": book_depth}
    if dataset in parsers:
        return parsers[dataset](rows, symbol, keep=keep)
    if not dataset.lower().endswith("klines"):
        raise ValueError(f"unknown dataset {dataset}")
    if interval is None:
        raise ValueError(f"{dataset} needs an interval")
    return klines(rows, symbol, interval, keep=keep)


def agg_trades(rows: DataFrame, symbol: str, keep: list[str] | None = None) -> DataFrame:
    return _numbered(rows).select(
        *(keep or []), F.lit(symbol.upper()).alias("symbol"), _cell(0).cast("long").alias("agg_trade_id"), _double(1).alias("price"), _double(2).alias("quantity"), _cell(3).cast("long").alias("first_trade_id"), _cell(4).cast("long").alias("last_trade_id"), _ms(5).alias("timestamp"), (F.lower(_cell(6)) == "true").alias("is_buyer_maker"), "sequence"
    )


def trades(rows: DataFrame, symbol: str, keep: list[str] | None = None) -> DataFrame:
    """A buyer that was the maker means that the taker sold."""
    return _numbered(rows).select(*(keep or []), F.lit(symbol.upper()).alias("symbol"), _cell(0).cast("long").alias("trade_id"), _double(1).alias("price"), _double(2).alias("quantity"), _ms(4).alias("timestamp"), F.when(F.lower(_cell(5)) == "true", "sell").otherwise("buy").alias("side"), "sequence")


def book_ticker(rows: DataFrame, symbol: str, keep: list[str] | None = None) -> DataFrame:
    at = F.timestamp_millis(F.coalesce(F.nullif(_cell(5), F.lit("")), _cell(0)).cast("long"))
    return _numbered(rows).select(*(keep or []), F.lit(symbol.upper()).alias("symbol"), at.alias("timestamp"), _double(1).alias("bid_px"), _double(2).alias("bid_sz"), _double(3).alias("ask_px"), _double(4).alias("ask_sz"), "sequence")


def book_depth(rows: DataFrame, symbol: str, keep: list[str] | None = None) -> DataFrame:
    """ISO times without a zone are UTC."""
    at = F.to_utc_timestamp(F.to_timestamp_ntz(F.regexp_replace(_cell(0), "T|Z$", " ").substr(1, 19)).cast("timestamp"), F.current_timezone())
    return _numbered(rows).select(*(keep or []), F.lit(symbol.upper()).alias("symbol"), at.alias("timestamp"), _double(1).alias("percentage"), _double(2).alias("depth"), _double(3).alias("notional"), "sequence")


def klines(rows: DataFrame, symbol: str, interval: str, keep: list[str] | None = None) -> DataFrame:
    """The event's time is the bar's close."""
    return _numbered(rows).select(
        *(keep or []), F.lit(symbol.upper()).alias("symbol"), F.lit(interval).alias("interval"), _ms(0).alias("open_time"), _ms(6).alias("timestamp"), _double(1).alias("open"), _double(2).alias("high"), _double(3).alias("low"), _double(4).alias("close"), _double(5).alias("volume"), _cell(8).cast("long").alias("trade_count"), "sequence"
    )


def archive_paths(days: DataFrame, dataset: str, symbol: str, interval: str | None = None) -> DataFrame:
    """Where the archive keeps each day's file: (day, path). Bar datasets need an interval."""
    if "lines" in dataset.lower() and interval is None:
        raise ValueError(f"{dataset} needs an interval")
    symbol = symbol.upper()
    folder = "/".join(x for x in (dataset, symbol, interval) if x)
    name = "-".join(x for x in (symbol, interval or dataset) if x)
    return days.select("day", F.format_string(f"data/futures/um/daily/{folder}/{name}-%s.zip", F.date_format("day", "yyyy-MM-dd")).alias("path"))


def day_grid(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))


def coverage(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Of a grid of days those present and missing, and the ratio (1 for an empty grid)."""
    marked = expected.join(present.select("day").distinct().withColumn("there", F.lit(True)), "day", "left")
    n, there = F.count(F.lit(1)), F.count_if(F.col("there"))
    return marked.agg(n.alias("expected"), there.alias("present"), F.sort_array(F.collect_list(F.when(F.col("there").isNull(), F.col("day")))).alias("missing"), F.when(n == 0, 1.0).otherwise(there / n).alias("ratio"))
