"""The medallion lake: layout, typed writers, manifests.

Tables are partitioned by coin and date and overwritten partition by partition, so a day can be loaded again
without touching others. An empty table is refused, as an empty partition would read as a day without data.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions import market

#: Layer of each table.
LAYERS = {"fills_raw": "bronze", "fills": "silver", "l2_book": "silver", "asset_ctxs": "silver", "candles": "silver", "markouts": "gold", "training_rows": "gold"}


def coin_folder(coin: str = "coin") -> Column:
    return F.upper(F.trim(F.replace(F.col(coin), F.lit("/"), F.lit("-"))))


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{LAYERS[name]}/{name}"


def write_table(rows: DataFrame, root: str, name: str) -> str:
    """Write one table's rows (with coin and ts_ms) to their partitions; returns the table's path."""
    if rows.isEmpty():
        raise ValueError(f"refusing to write an empty {name}")
    path = table_path(root, name)
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.expr("cast(ts_ms div 86400000 as int)")), "yyyyMMdd")
    rows = rows.withColumns({"coin": coin_folder(), "date": day})
    rows.hint("rebalance", "coin", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("coin", "date").parquet(path)
    return path


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(table_path(root, name))


def bronze_fills(fills: DataFrame) -> DataFrame:
    """Fills as they came, with maker side; raw_json keeps the original record."""
    return fills.withColumn("maker_side", market.maker_side())


def silver_fills(fills: DataFrame) -> DataFrame:
    return fills.withColumns({"notional": F.col("px") * F.col("sz"), "maker_side": market.maker_side(), "fee_bps": market.fee_bps()}).drop("raw_json", "builder_fee")


def silver_book(top: DataFrame) -> DataFrame:
    return top.withColumns({"mid": market.mid(), "spread_bps": market.spread_bps(), "microprice": market.microprice(), "top_imbalance": market.top_imbalance()})


def silver_contexts(contexts: DataFrame) -> DataFrame:
    return contexts.withColumn("basis_bps", market.basis_bps())


def silver_candles(candles: DataFrame) -> DataFrame:
    """Candles by the time of their close."""
    return candles.select("coin", "interval", F.col("close_ts_ms").alias("ts_ms"), "open_ts_ms", "open", "high", "low", "close", "volume", "trade_count")


def newest_partition(spark: SparkSession, path: str, date: str | None = None) -> DataFrame:
    """Rows of the partition of ``date``, or of the newest one where that is missing, in order of time."""
    rows = spark.read.parquet(path)
    there = {m[1] for f in rows.inputFiles() if (m := re.search(r"/date=([^/]+)/", f))}  # from the listing, no data are read
    return rows.filter(F.col("date").cast("string") == (date if date in there else max(there))).orderBy("ts_ms")


def resolve_partitions(spark: SparkSession, path: str, coins: list[str], dates: list[str]) -> DataFrame:
    """The requested grid of coins and dates, and whether the lake has each."""
    grid = spark.createDataFrame([(c, d) for c in coins for d in dates], "coin string, date string")
    there = spark.read.parquet(path).select("coin", F.col("date").cast("string").alias("date")).distinct().withColumn("there", F.lit(True))
    return grid.join(there, ["coin", "date"], "left").select("coin", "date", F.coalesce("there", F.lit(False)).alias("there"))


def training_panel(spark: SparkSession, path: str, coins: list[str], dates: list[str], columns: list[str], max_rows: int = 0) -> DataFrame:
    """Rows of the requested partitions with only ``columns``, and where they come from; in order of time, the first ``max_rows`` if given."""
    rows = spark.read.parquet(path).filter(F.col("coin").isin(coins) & F.col("date").cast("string").isin(dates))
    panel = rows.select("coin", F.col("date").cast("string").alias("date"), *columns, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("source"))
    panel = panel.orderBy("ts_ms", "coin")
    return panel.limit(max_rows) if max_rows else panel


def write_scenarios(events: DataFrame, labels: DataFrame, root: str) -> None:
    """Events and labels as JSON, a folder for each scenario, and a manifest with each one's hash, family and size."""
    events.write.mode("overwrite").partitionBy("scenario_id").json(f"{root}/events")
    labels.write.mode("overwrite").partitionBy("scenario_id").json(f"{root}/labels")
    entries = F.array_sort(F.collect_list(F.struct("ts_ms", "event_id")))
    index = events.groupBy("scenario_id").agg(F.first("family").alias("family"), F.count(F.lit(1)).alias("n_events"), F.sha2(F.to_json(entries), 256).alias("hash"))
    index.write.mode("overwrite").json(f"{root}/manifest")


def read_scenarios(spark: SparkSession, root: str) -> DataFrame:
    """One row per event with its label and its scenario's family."""
    events, labels, index = (spark.read.json(f"{root}/{name}") for name in ("events", "labels", "manifest"))
    rows = events.drop("family").join(labels, ["scenario_id", "event_id"]).join(index.select("scenario_id", "family"), "scenario_id")
    return rows.withColumn("mark", F.concat_ws(":", F.lit("agent_order"), "action", "side"))


def write_leaderboard(runs: DataFrame, path: str) -> None:
    """Runs (name, metrics as a map) as one CSV whose header is the sorted union of the metrics."""
    keys = [r["k"] for r in runs.select(F.explode(F.map_keys("metrics")).alias("k")).distinct().orderBy("k").collect()]  # as many as there are metrics
    runs.select("name", *[F.col("metrics")[k].alias(k) for k in keys]).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_json_report(rows: DataFrame, path: str) -> None:
    """A report's rows as one JSON document, an array of objects with sorted keys. For reports: their rows meet in one line."""
    each = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    lines = F.array_join(F.array_sort(F.collect_list(each)), ",\n  ")
    rows.agg(F.concat(F.lit("[\n  "), lines, F.lit("\n]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_markdown_report(rows: DataFrame, path: str, order: list[str]) -> None:
    """A report's rows as a table in markdown, in order; a missing value is a dash."""
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("-")) for c in rows.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(rows.columns) + " |"), (1, "|-" * len(rows.columns) + "|")], "nth int, value string")
    body = rows.select(F.lit(2).alias("nth"), line.alias("value"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])
    both = head.unionByName(body, allowMissingColumns=True).coalesce(1).sortWithinPartitions("nth", *[f"_{i}" for i in range(len(order))])
    both.select("value").write.mode("overwrite").text(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Of every file below ``path`` its sha256 and size. Contents are hashed where they are read, never gathered."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def manifest_hash(files: DataFrame) -> DataFrame:
    """One hash over a manifest's records, ordered by path."""
    records = F.array_sort(F.collect_list(F.struct("path", "sha256", "bytes")))
    return files.agg(F.sha2(F.to_json(records), 256).alias("hash"), F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"))
