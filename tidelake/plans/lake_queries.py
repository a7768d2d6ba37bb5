"""Snapshots of several tables, incremental builds, archive objects and streams, each driven to its end over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.operators import ingest, lake
from tidelake.operators.snapshots import Snapshots, Upsert
from tidelake.plans import adapters as v
from tidelake.plans.registry import query
from tidelake.session import new_folder
from tidelake.sources import archive_objects, exchange_csv, venue_json
from tidelake.streaming import ordered_stream

H = v.HOUR

_PERSIST_SQL = v.with_views("""
SELECT user_id, arg_max(event_type, (ts_ms, event_id)) AS last_type, count(*) FILTER (event_type = 'error') AS n_alerts,
       max(event_id) FILTER (event_type = 'error') AS last_alert
FROM ev GROUP BY user_id""")


@query("q_K18_atomic_persist", _PERSIST_SQL)
def atomic_persist(spark, sf):
    """Users, alerts and links between them, upserted together in two commits; the newest snapshot's tables joined."""
    rows = v.events(spark, sf)
    store = Snapshots(spark, new_folder(spark))
    for part in (rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")):
        users = part.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts_ms", "event_id")).alias("last_type"), F.max(F.struct("ts_ms", "event_id")).alias("at"))
        alerts = part.filter("event_type = 'error'")
        store.commit({
            "users": Upsert(users.select("user_id", "last_type", "at.ts_ms", "at.event_id"), ["user_id"], ["ts_ms", "event_id"]),
            "alerts": Upsert(alerts.select(F.col("event_id").alias("alert_id"), "ts_ms", "value"), ["alert_id"]),
            "links": Upsert(alerts.select("user_id", F.col("event_id").alias("alert_id")), ["user_id", "alert_id"]),
        })
    linked = store.read("links").join(store.read("alerts").select("alert_id"), "alert_id")
    counts = linked.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_alerts"), F.max("alert_id").alias("last_alert"))
    return store.read("users").join(counts, "user_id", "left").select("user_id", "last_type", F.coalesce("n_alerts", F.lit(0)).alias("n_alerts"), "last_alert")


_INGEST_SQL = v.with_views("""
SELECT ts_ms // 86400000 AS day, count(*) AS n, round(sum(quantity) + 1.3e-8, 4) AS quantity, min(order_id) AS first_id, max(order_id) AS last_id FROM v_orders GROUP BY 1""")


@query("q_K14_incremental_ingest", _INGEST_SQL)
def incremental_ingest(spark, sf):
    """Daily archive files of which half are there at first; the build runs after each half, and once more with nothing new."""
    root, day = new_folder(spark), F.expr("ts_ms div 86400000")
    cells = F.concat_ws(",", "order_id", "price", "quantity", "order_id", "order_id", "ts_ms", (F.col("side") == "sell").cast("string"))
    files = v.orders(spark, sf).select(day.alias("day"), cells.alias("value"))
    store = Snapshots(spark, f"{root}/store")
    for some in ("day % 2 = 0", "day % 2 = 1", None):
        if some:
            files.filter(some).repartition("day").write.mode("append").partitionBy("day").text(f"{root}/raw/aggTrades/ALL")
        version = ingest.ingest(spark, f"{root}/raw", store, f"{root}/state", "aggTrades", "ALL")
    if version != 2:
        raise RuntimeError(f"three builds over two sets of files made {version} snapshots")
    rows = store.read("aggTrades").withColumn("day", F.expr("unix_millis(timestamp) div 86400000"))
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("quantity") + 1.3e-8, 4).alias("quantity"), F.min("agg_trade_id").alias("first_id"), F.max("agg_trade_id").alias("last_id"))


_OBJECTS_SQL = v.with_views("SELECT 'C' || coin AS coin, ts_ms, bid_px, ask_px, bid_sz, ask_sz FROM v_book")


@query("q_S11_archive_objects", _OBJECTS_SQL)
def archive_books(spark, sf):
    """The book written as LZ4 objects under the archive's keys, one for each coin's hour, and read back."""
    root = new_folder(spark)
    level = lambda side: F.array(F.struct(F.col(f"{side}_px").cast("string").alias("px"), F.col(f"{side}_sz").cast("string").alias("sz"), F.lit(1).alias("n")))
    book = F.struct(F.concat(F.lit("C"), "coin").alias("coin"), F.col("ts_ms").alias("time"), F.array(level("bid"), level("ask")).alias("levels"))
    hours = v.book(spark, sf).withColumns({"date": F.expr("date_add(DATE'1970-01-01', cast(ts_ms div 86400000 as int))"), "hour": F.expr("ts_ms % 86400000 div 3600000"), "line_no": F.col("tie"), "value": F.to_json(F.struct(F.struct(book.alias("data")).alias("raw")))})
    keyed = hours.withColumn("coin", F.concat(F.lit("C"), "coin"))
    names = venue_json.archive_keys(keyed.select("coin", "date", "hour").distinct()).select("coin", "date", "hour", F.col("book_key").alias("object"))
    archive_objects.write_objects(keyed.join(names, ["coin", "date", "hour"]), root).write.format("noop").mode("overwrite").save()
    return venue_json.top_of_book(archive_objects.load_books(spark, root)).select("coin", "ts_ms", "bid_px", "ask_px", "bid_sz", "ask_sz")


_ROLLING_SQL = v.with_views(f"""
SELECT order_id, count(*) OVER w AS n, round(sum(quantity) OVER w, 6) AS quantity FROM v_orders
WINDOW w AS (PARTITION BY scenario_id ORDER BY ts_ms RANGE BETWEEN {H} PRECEDING AND CURRENT ROW), k AS (PARTITION BY scenario_id)
QUALIFY ts_ms <= max(ts_ms) OVER k - {H}""")


@query("q_X03_rolling_state", _ROLLING_SQL)
def rolling_state(spark, sf):
    """Orders as a stream through ordered, evicting state; what the last hour still holds back is not out yet."""
    root = new_folder(spark)
    v.orders(spark, sf).select("scenario_id", "order_id", "sequence", "ts_ms", "quantity").write.parquet(f"{root}/in")
    before = {c: spark.conf.get(c, None) for c in ordered_stream.STATE_STORE}
    for c, value in ordered_stream.STATE_STORE.items():
        spark.conf.set(c, value)
    try:
        stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
        rows = ordered_stream.rolling_state(stream, "scenario_id", "quantity", H, H, peers=True)
        query = rows.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    finally:
        for c, value in before.items():
            spark.conf.set(c, value) if value else spark.conf.unset(c)
    return spark.read.schema(rows.schema).parquet(f"{root}/out").filter("not late").select("order_id", "n", F.round("total", 6).alias("quantity"))


_REPORTS_SQL = v.with_views("""WITH r AS (SELECT scenario, count(*) AS n, round(avg(p), 6) AS mean_p, CASE WHEN count(*) % 2 = 0 THEN round(max(markout), 6) END AS best FROM v_scores GROUP BY scenario)
SELECT scenario, n, mean_p, best, '| ' || scenario || ' | ' || n || ' | ' || mean_p || ' | ' || coalesce(best::varchar, '-') || ' |' AS line FROM r""")


@query("q_K15_report_files", _REPORTS_SQL)
def report_files(spark, sf):
    """A report as a JSON document and as a table in markdown, both read back."""
    root, p = new_folder(spark), F.col("p")
    n = F.count(F.lit(1))
    rows = v.scores(spark, sf).groupBy("scenario").agg(n.alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.when(n % 2 == 0, F.round(F.max("markout"), 6)).alias("best"))
    lake.write_json_report(rows, f"{root}/json")
    lake.write_markdown_report(rows, f"{root}/markdown", ["scenario"])
    read = spark.read.schema("scenario string, n bigint, mean_p double, best double").option("multiLine", "true").json(f"{root}/json")
    lines = spark.read.text(f"{root}/markdown").filter("value like '| __ |%'").select(F.trim(F.split("value", r"\|")[1]).alias("scenario"), F.col("value").alias("line"))
    return read.join(lines, "scenario")


_ZIPS_SQL = v.with_views("SELECT coin AS symbol_no, tie AS sequence_key, round(open, 6) AS open, round(close, 6) AS close, ts_ms FROM v_bars")


@query("q_S07_zip_scan", _ZIPS_SQL)
def zip_scan(spark, sf):
    """Each coin's bars as a zipped CSV of the archive, read back by the bars' own parser."""
    root = new_folder(spark)
    cells = F.concat_ws(",", F.col("ts_ms") - 59_999, "open", "high", "low", "close", F.abs("volume"), "ts_ms", F.lit(0), "tie")
    lines = v.bars(spark, sf).select(F.concat(F.lit("bars-"), "coin", F.lit(".zip")).alias("object"), F.col("tie").alias("line_no"), cells.alias("value"))
    exchange_csv.write_zipped(lines, root).write.format("noop").mode("overwrite").save()
    rows = exchange_csv.parse(exchange_csv.data_rows(exchange_csv.read_zipped_lines(spark, root)), "klines", "x", "1m", keep=["file"])
    number = F.regexp_extract("file", r"bars-(\d+)\.zip", 1).cast("long")
    return rows.select(number.alias("symbol_no"), F.col("trade_count").alias("sequence_key"), F.round("open", 6).alias("open"), F.round("close", 6).alias("close"), F.unix_millis("timestamp").alias("ts_ms"))
