"""Venue archives: order-book snapshots as NDJSON, fills in nested JSON, contexts as CSV or API reply, candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.market import normalised_side
from tidelake.session import checkpointed

_BOOK = "struct<coin:string,time:bigint,levels:array<array<struct<px:string,sz:string,n:int>>>>"
_FILL = "coin:string,px:string,sz:string,side:string,time:bigint,crossed:string,oid:bigint,tid:bigint,hash:string,fee:string,feeToken:string,builderFee:string,dir:string"
# The keys under which fills come in lists.
_LISTS = ("events", "fills", "userFills", "node_fills", "nodeFills")


def l2_book(lines: DataFrame) -> DataFrame:
    """Snapshots from lines in any of the envelopes: bare, {data}, {raw: {data}}. bids and asks are arrays, best first."""
    parsed = F.from_json("value", f"struct<{_BOOK[7:-1]},data:{_BOOK},raw:struct<data:{_BOOK},{_BOOK[7:-1]}>>")
    rows = lines.filter(F.trim("value") != "").select(parsed.alias("r"))
    bare = lambda x: F.when(x["levels"].isNotNull(), F.struct(x["coin"].alias("coin"), x["time"].alias("time"), x["levels"].alias("levels")))
    book = F.coalesce(F.when(F.col("r.raw.data.levels").isNotNull(), F.col("r.raw.data")), bare(F.col("r.raw")), F.when(F.col("r.data.levels").isNotNull(), F.col("r.data")), bare(F.col("r")))
    side = lambda i: F.transform(F.get("b.levels", F.lit(i)), lambda x: F.struct(x["px"].cast("double").alias("px"), x["sz"].cast("double").alias("sz"), x["n"].alias("n")))
    return rows.select(book.alias("b")).filter("b is not null").select(F.col("b.time").alias("ts_ms"), "b.coin", side(0).alias("bids"), side(1).alias("asks"))


def top_of_book(snapshots: DataFrame) -> DataFrame:
    """Best bid and ask of each snapshot; an empty side is an error."""
    best = lambda s: F.coalesce(F.get(s, F.lit(0)), F.raise_error(F.concat(F.lit("empty side in "), "coin")).cast("struct<px:double,sz:double,n:int>"))
    rows = snapshots.select("coin", "ts_ms", best("bids").alias("bid"), best("asks").alias("ask"))
    return rows.select("coin", "ts_ms", F.col("bid.px").alias("bid_px"), F.col("bid.sz").alias("bid_sz"), F.col("bid.n").alias("bid_n"), F.col("ask.px").alias("ask_px"), F.col("ask.sz").alias("ask_sz"), F.col("ask.n").alias("ask_n"))


def node_fills(documents: DataFrame) -> DataFrame:
    """Fills out of nested JSON documents (column value): lists, {fill}, lists under one of five keys, [user, fill] pairs.

    Variants are unwrapped level by level: each round opens one layer of whatever isn't a fill yet, until nothing is
    left to open, however deep. A level is written before the next one reads it, so the source is parsed once. What
    is neither a fill nor a wrapper drops out.
    """
    level = documents.select(F.try_parse_json("value").alias("v")).filter("v is not null")
    found: DataFrame | None = None
    while True:
        level = checkpointed(level)
        if found is not None and level.isEmpty():
            break
        is_list = F.schema_of_variant("v").startswith("ARRAY")
        flat = level.select(F.when(is_list, F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v")).alias("x")).select(F.explode("x").alias("v")).filter("v is not null")
        kind = F.schema_of_variant("v")
        is_fill = kind.startswith("OBJECT") & F.try_variant_get("v", "$.px", "string").isNotNull() & F.try_variant_get("v", "$.coin", "string").isNotNull()
        fills = flat.filter(is_fill)
        found = fills if found is None else found.unionByName(fills)
        inner = F.coalesce(F.try_variant_get("v", "$.fill", "variant"), *[F.try_variant_get("v", f"$.{k}", "variant") for k in _LISTS])
        level = flat.filter(~is_fill & (kind.startswith("OBJECT") | kind.startswith("ARRAY"))).select(F.when(kind.startswith("ARRAY"), F.col("v")).otherwise(inner).alias("v")).filter("v is not null")
    fields = [f.split(":") for f in _FILL.split(",")]
    return found.select(*[F.try_variant_get("v", f"$.{n}", t).alias(n) for n, t in fields], F.to_json("v").alias("raw_json"))


def json_or_lines(texts: DataFrame) -> DataFrame:
    """Documents (value) of whole files: one per line, if several lines are JSON each or the whole is not, else one."""
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    by_line = ((F.size(lines) > 1) & F.forall(lines, lambda x: F.try_parse_json(x).isNotNull())) | F.try_parse_json("value").isNull()
    return texts.select(F.explode(F.when(by_line, lines).otherwise(F.array("value"))).alias("value"))


# The words for crossed and not crossed.
_CROSSED, _RESTED = ("1", "true", "t", "yes", "y"), ("0", "false", "f", "no", "n")


def typed_fills(fills: DataFrame) -> DataFrame:
    """Numbers, side as B or A, crossed as true, false or, where missing, unknown; any other word for it is an error where the value is used."""
    word = F.lower(F.trim("crossed"))
    crossed = F.when(word.isNull() | (word == ""), F.lit(None).cast("boolean")).when(word.isin(*_CROSSED), True).when(word.isin(*_RESTED), False)
    crossed = crossed.otherwise(F.raise_error(F.concat(F.lit("unknown word for crossed: "), word)).cast("boolean"))
    number = lambda c: F.nullif(F.col(c), F.lit("")).cast("double")
    return fills.select("coin", F.col("time").alias("ts_ms"), number("px").alias("px"), number("sz").alias("sz"), normalised_side().alias("side"), crossed.alias("crossed"), "oid", "tid", "hash", number("fee").alias("fee"), F.col("feeToken").alias("fee_token"), number("builderFee").alias("builder_fee"), F.col("dir").alias("direction"), "raw_json")


# Archive names of context columns and the API's.
CONTEXT_NAMES = {"openInterest": "open_interest", "oraclePx": "oracle_px", "markPx": "mark_px", "midPx": "mid_px"}


def asset_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Contexts from CSV with either style of header. Rows without a time are static; mid falls back to mark, premium to 0."""
    return context_rows(spark.read.csv(path, header=True))


def context_rows(rows: DataFrame) -> DataFrame:
    """Typed contexts from rows of text under either style of names."""
    for api, ours in CONTEXT_NAMES.items():
        if api in rows.columns:
            rows = rows.withColumnRenamed(api, ours)
    if "time" not in rows.columns:
        rows = rows.withColumn("time", F.lit(None).cast("string"))
    optional = lambda c: F.nullif(F.col(c), F.lit("")).cast("double") if c in rows.columns else F.lit(None).cast("double")
    needed = lambda c: F.coalesce(optional(c), F.raise_error(F.lit(f"missing {c}")).cast("double"))
    return rows.select(
        "coin", needed("funding").alias("funding"), needed("open_interest").alias("open_interest"), needed("oracle_px").alias("oracle_px"), needed("mark_px").alias("mark_px"), F.coalesce(optional("mid_px"), needed("mark_px")).alias("mid_px"), F.coalesce(optional("premium"), F.lit(0.0)).alias("premium"), epoch_ms("time").alias("ts_ms")
    )


def epoch_ms(column: str) -> Column:
    """Milliseconds from digits or from an ISO time with up to nine decimals; without a zone it is UTC."""
    text = F.trim(column)
    iso = F.concat(F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)", 1), F.lit(" "), F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)", 2))
    millis = F.rpad(F.regexp_extract(text, r"\.(\d{1,3})", 1), 3, "0")
    since = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), iso.cast("timestamp_ntz"))
    return F.when(text.rlike("^[0-9]+$"), text.cast("long")).when(text != "", since * 1000 + millis.cast("long"))


def universe_contexts(replies: DataFrame) -> DataFrame:
    """The API's reply pairs names and contexts by position (column value: [{universe}, [contexts]]); unequal lengths are an error."""
    schema = "array<string>"
    parts = F.from_json("value", schema)
    names = F.from_json(parts[0], "struct<universe:array<struct<name:string>>>")["universe"]
    contexts = F.from_json(parts[1], "array<struct<funding:string,openInterest:string,oraclePx:string,markPx:string,midPx:string,premium:string>>")
    rows = replies.select(names.alias("names"), contexts.alias("contexts"))
    same = F.when(F.size("names") == F.size("contexts"), F.arrays_zip("names", "contexts")).otherwise(F.raise_error(F.lit("universe and contexts differ in length")).cast("array<struct<names:struct<name:string>,contexts:struct<funding:string,openInterest:string,oraclePx:string,markPx:string,midPx:string,premium:string>>>"))
    x = rows.select(F.explode(same).alias("z"))
    return x.select(F.col("z.names.name").alias("coin"), *[F.col(f"z.contexts.{api}").cast("double").alias(ours) for api, ours in ({"funding": "funding"} | CONTEXT_NAMES | {"premium": "premium"}).items()])


# The API's abbreviated candle keys; t and T differ in case alone, so keys are read one by one.
_CANDLE = {"s": ("coin", "string"), "i": ("interval", "string"), "t": ("open_ts_ms", "bigint"), "T": ("close_ts_ms", "bigint"), "o": ("open", "double"), "h": ("high", "double"), "l": ("low", "double"), "c": ("close", "double"), "v": ("volume", "double"), "n": ("trade_count", "bigint")}


def candles(lines: DataFrame) -> DataFrame:
    return lines.select(*[F.get_json_object("value", f"$.{k}").cast(kind).alias(name) for k, (name, kind) in _CANDLE.items()])


def archive_keys(hours: DataFrame) -> DataFrame:
    """Where the venue's archive keeps the book of a coin's hour and the contexts of its day, from (coin, date, hour)."""
    day = F.date_format("date", "yyyyMMdd")
    book = F.format_string("market_data/%s/%d/l2Book/%s.lz4", day, F.col("hour").cast("int"), F.col("coin"))
    return hours.select("coin", "date", "hour", book.alias("book_key"), F.format_string("asset_ctxs/%s.csv.lz4", day).alias("contexts_key"))


# The canonical events by type, with the fields that each needs.
EVENT_FIELDS = {
    "agg_trade": "symbol string, price double, quantity double, is_buyer_maker boolean", "trade": "symbol string, price double, quantity double, side string", "hyperliquid_fill": "coin string, px double, sz double, side string", "book_depth": "symbol string, percentage double, depth double",
    "book_ticker": "symbol string, bid_price double, ask_price double", "kline": "symbol string, open double, high double, low double, close double", "agent_order": "agent_id string, order_id string, action string, price double, quantity double",
}


def parse_events(lines: DataFrame) -> dict[str, DataFrame]:
    """Events (column value: JSON with event_type and timestamp_ms) of every type, each with its own fields; an unknown type is an error where it is read."""
    kind = F.get_json_object("value", "$.event_type")
    known = F.when(kind.isin(*EVENT_FIELDS), kind).otherwise(F.raise_error(F.concat(F.lit("unknown event type "), F.coalesce(kind, F.lit("null")))))
    typed = lines.withColumn("event_type", known)
    schema = "timestamp_ms bigint, "
    return {name: typed.filter(F.col("event_type") == name).select("event_type", F.from_json("value", schema + fields).alias("e")).select("event_type", "e.*") for name, fields in EVENT_FIELDS.items()}
