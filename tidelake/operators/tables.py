"""Table maintenance and serving: upserts, latest rows, manifests, pages, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelake.operators import ordered


def upsert(known: DataFrame, new: DataFrame, key: list[str], newest: Column) -> DataFrame:
    """Of each key the newest row of both tables; an aggregate, so that hot keys combine before the shuffle."""
    both = known.unionByName(new, allowMissingColumns=True)
    return both.groupBy(*key).agg(F.max_by(F.struct(*both.columns), newest).alias("row")).select("row.*")


def latest(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(max(1, min(100, n)))


def page(rows: DataFrame, number: int, *order: Column, size: int = 100) -> DataFrame:
    return rows.orderBy(*order).offset(number * size).limit(size)


def top_entries(map_column: str, k: int) -> Column:
    """The k entries of a map largest by absolute value, then by key."""
    order = lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(F.abs(a["value"]) < F.abs(b["value"]), 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    return F.slice(F.array_sort(F.map_entries(map_column), order), 1, k)


def content_hash(rows: DataFrame, order: list[str], columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """sha256 over the rows in order of a small table (a manifest: one row per file), or of each key's small group (a run)."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))), lambda r: F.concat_ws("|", *[r[c].cast("string") for c in columns]))
    return rows.groupBy(*(keys or [])).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("hash"))


def vocabulary(rows: DataFrame, column: str) -> DataFrame:
    """Tokens of the sorted distinct values from 1; 0 is for padding. As many rows as values: numbered by parts, to be joined, not broadcast."""
    return ordered.running(rows.select(column).distinct(), column, {"token": F.lit(1)}).drop("token_all")


def padded_sequences(rows: DataFrame, key: str, order: str, value: str, width: int) -> DataFrame:
    """Per key the first ``width`` values in order, padded with 0, and how many are real. What comes after is never gathered."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order, value))
    first = rows.withColumn("_nth", nth).filter(F.col("_nth") <= width)
    lists = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", value))), lambda x: x[value]).alias("values"))
    return lists.select(key, F.slice(F.concat("values", F.array_repeat(F.lit(0), width)), 1, width).alias("tokens"), F.size("values").alias("n"))


def filtered(rows: DataFrame, among: dict[str, list] | None = None, text: str = "", searched: list[str] | None = None) -> DataFrame:
    """Rows whose columns have one of the given values and where the text occurs, in any case, in one of the searched columns."""
    for column, values in (among or {}).items():
        rows = rows.filter(F.col(column).isin(values))
    if text and searched:
        hit = F.lit(False)
        for column in searched:
            hit = hit | F.coalesce(F.contains(F.lower(column), F.lit(text.lower())), F.lit(False))
        rows = rows.filter(hit)
    return rows


def persist_run(tables: dict[str, DataFrame], root: str, run_id: str) -> None:
    """Several tables of one run, written below its id; the run counts once its marker is written, last."""
    for name, rows in tables.items():
        rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").parquet(f"{root}/{name}/run={run_id}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(run_id, sorted(tables))], "run_id string, tables array<string>").write.mode("append").parquet(f"{root}/_runs")


def read_run_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table's rows of all runs that were written to the end."""
    complete = spark.read.parquet(f"{root}/_runs").filter(F.array_contains("tables", name)).select("run_id").distinct()
    return spark.read.parquet(f"{root}/{name}/*").join(complete, "run_id", "left_semi")


def job_status(log: DataFrame) -> DataFrame:
    """Of each job its latest state and how long it ran, from rows that are only ever appended (job, status, at_ms, nth)."""
    return log.groupBy("job").agg(F.max_by("status", F.struct("at_ms", "nth")).alias("status"), (F.max("at_ms") - F.min("at_ms")).alias("took_ms"), F.count(F.lit(1)).alias("n"))
