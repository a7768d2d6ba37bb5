"""Running sums over a whole table's order, without putting the table into one task.

A table that Spark's own estimate puts below ``SMALL_BYTES`` is summed up by one window. Others are cut into parts of
some ``PART_BYTES`` by Spark's range partitioning over keys, order column and tie, so a key or a value with many rows
is cut, too. The parts are written once (``checkpoint``), so they are read as they were cut, and inputs are read
once. Each part is summed up on its own, in order; what comes before it is added from a table with one row for each
part and key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.session import checkpointed

SMALL_BYTES, PART_BYTES = 32 << 20, 64 << 20
#: No more parts than this are made by estimate, as one row for each and key is summed up in a window.
MOST_PARTS = 20_000


def estimated_bytes(rows: DataFrame) -> int | None:
    """A table's size by the optimiser's estimate, if there is one.

    A join is put at the product of its sides, so what all inputs hold together is the most that counts.
    """
    plan = rows._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    size, read = (sum(int(str(p.stats().sizeInBytes())) for p in plans) for plans in ([plan], [leaves.apply(i) for i in range(leaves.size())]))
    size = min(size, read)
    return size if size < 1 << 60 else None  # what Spark puts for a source that can't tell, and products of it


def parts_for(rows: DataFrame) -> int:
    """How many parts suit a table, by the optimiser's estimate; where there is none, as many as a shuffle has."""
    size = estimated_bytes(rows)
    if size is None:
        return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 if size <= SMALL_BYTES else min(MOST_PARTS, -(-size // PART_BYTES))


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Equality in which null equals null."""
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in columns))


def running(rows: DataFrame, column: str, sums: dict[str, Column], keys: list[str] | None = None, tie: list[str] | None = None, descending: bool = False, parts: int | None = None) -> DataFrame:
    """Per key, for each name its sum up to and with the row, and ``{name}_all``, the sum of the key's rows. Null keys are a key."""
    keys, order = keys or [], [(F.desc if descending else F.asc)(column), *(tie or [])]
    parts, whole = parts or parts_for(rows), Window.partitionBy(*keys)
    if parts == 1:
        upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumns({f"_each_{n}": c for n, c in sums.items()})
        found = rows.withColumns({n: F.sum(f"_each_{n}").over(upto) for n in sums} | {f"{n}_all": F.sum(f"_each_{n}").over(whole) for n in sums})
        return found.drop(*[f"_each_{n}" for n in sums])
    cut = rows.withColumns({f"_each_{n}": c for n, c in sums.items()}).repartitionByRange(parts, *keys, *order)
    cut = checkpointed(cut.withColumn("_part", F.spark_partition_id()))
    by_part = cut.groupBy(*keys, "_part").agg(*[F.sum(f"_each_{n}").alias(n) for n in sums])
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over parts, not rows
    before = by_part.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_part").alias("_of"),
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums], *[F.sum(n).over(whole).alias(f"{n}_all") for n in sums],
    )
    so_far = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = cut.withColumns({f"_within_{n}": F.sum(f"_each_{n}").over(so_far) for n in sums})
    met = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)), F.col("_part") == F.col("_of"))
    joined = within.join(before.hint("merge"), met)
    helpers = ["_part", "_of", *[f"_key{i}" for i in range(len(keys))], *[f"_{what}_{n}" for n in sums for what in ("each", "before", "within")]]
    return joined.withColumns({n: F.col(f"_before_{n}") + F.col(f"_within_{n}") for n in sums}).drop(*helpers)


def average_ranks(rows: DataFrame, column: str, keys: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """value, rank and n of each key's distinct values: of equal ones the mean of their places from 1."""
    keys = keys or []
    counts = rows.groupBy(*keys, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return running(counts, "value", {"upto": F.col("n")}, keys, parts=parts).select(*keys, "value", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"), "n", "upto_all")


def tiles(rows: DataFrame, n: int, column: str, tie: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """``tile`` from 0: n contiguous tiles in order, the first ones a row longer where rows don't divide evenly."""
    placed = running(rows, column, {"_place": F.lit(1)}, tie=tie, parts=parts)
    size, extra, place = F.floor(F.col("_place_all") / n), F.col("_place_all") % n, F.col("_place") - 1
    longer = extra * (size + 1)
    return placed.withColumn("tile", F.when(place < longer, F.floor(place / (size + 1))).otherwise(extra + F.floor(F.try_divide(place - longer, size))).cast("int")).drop("_place", "_place_all")


def nth_values(rows: DataFrame, column: str, places: dict[str, Column], keys: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Per key the values at given places (from 1) in order; a place may depend on ``n``, the key's rows."""
    keys = keys or []
    counts = rows.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    steps = running(counts, column, {"_upto": F.col("_n")}, keys, parts=parts).withColumn("n", F.col("_upto_all"))
    return steps.groupBy(*keys, "n").agg(*[F.min(F.when(F.col("_upto") >= at, F.col(column))).alias(name) for name, at in places.items()])


def percentiles(rows: DataFrame, column: str, shares: dict[str, float], keys: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Per key exact percentiles with linear interpolation, null values left out, from counts of values: no state holds a column.

    Rank q * (n - 1) lies between the values at its floor and its ceiling.
    """
    rank = {name: q * (F.col("n") - 1) for name, q in shares.items()}
    places = {f"_lo_{name}": F.floor(r) + 1 for name, r in rank.items()} | {f"_hi_{name}": F.ceil(r) + 1 for name, r in rank.items()}
    found = nth_values(rows.filter(F.col(column).isNotNull()), column, places, keys, parts)
    low, high = (lambda name: F.col(f"_lo_{name}").cast("double")), (lambda name: F.col(f"_hi_{name}").cast("double"))
    between = {name: F.when(low(name) == high(name), low(name)).otherwise((F.ceil(r) - r) * low(name) + (r - F.floor(r)) * high(name)) for name, r in rank.items()}
    return found.select(*(keys or []), "n", *[c.alias(name) for name, c in between.items()])
