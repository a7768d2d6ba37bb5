"""Point-in-time joins and exact prefix windows: each one union or window, one shuffle by key and slice, one sort.

As-of joins put both sides into one stream per key, sorted by time (downwards, to look ahead), and carry the
right side's last row along. Nothing is compared pairwise, so the cost is that of one sort. Keys are cut into
time slices of ``slice_ms``, each sorted on its own, so that a key with a large share of all rows is not one
task's; the last right row before a slice is handed to it from a small table of slices.

Rolling windows are cut likewise (``sliced``): a slice also gets the rows of a window's length before it, so all that
a row's window holds is in the row's own slice, and no state passes between slices. Moving extremes take running
frames only: a window of length w meets at most two blocks of length w, the end of one and the beginning of the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A day.
SLICE_MS = 86_400_000


def _stream(left: DataFrame, right: DataFrame, key: str, shift: int, left_first: bool) -> tuple[DataFrame, list[str], list[str]]:
    """Both sides in one stream: (key, at, order, tie, left row, right row)."""
    payload, own = [c for c in right.columns if c not in (key, "tie")], left.columns
    tie = F.col("tie") if "tie" in right.columns else F.lit(0)
    no_tie = F.lit(None).cast(right.select(tie.alias("tie")).schema["tie"].dataType)
    from_left = left.select(F.col(key).alias("_key"), (F.col("ts_ms") + shift).alias("_at"), F.lit(0 if left_first else 1).alias("_order"), no_tie.alias("_tie"), F.struct(*own).alias("_left"))
    from_right = right.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col("ts_ms").alias("_at"), F.lit(1 if left_first else 0).alias("_order"), tie.alias("_tie"), F.struct(*payload).alias("_right"))
    return from_left.unionByName(from_right, allowMissingColumns=True), own, payload


def _carried(stream: DataFrame, into: str, downwards: bool, slice_ms: int) -> DataFrame:
    """The stream with the right row met last on the way up, or down, in time. Either way the frame starts at the first row, which costs one pass."""
    at, way = ("_at", "_order", "_tie"), F.desc if downwards else F.asc
    # The table of slices and the frames read one exchange, so inputs are read once. For that it must look alike from
    # both: the table counts what else it holds, and takes the keys as aggregates, below which no filter is pushed.
    stream = stream.withColumn("_slice", F.floor(F.col("_at") / slice_ms)).repartition("_key", "_slice")
    outermost = (F.min_by if downwards else F.max_by)("_right", F.when(F.col("_right").isNotNull(), F.struct(*at)))
    others = [F.count(c).alias(f"_n{c}") for c in stream.columns if c not in ("_key", "_slice", "_right", *at)]
    of_slice = stream.groupBy("_key", "_slice").agg(outermost.alias("_best"), F.max("_key").alias("_k"), F.max("_slice").alias("_s"), *others)
    of_slice = of_slice.filter(F.greatest(F.lit(0), *[F.col(c) for c in of_slice.columns if c.startswith("_n_")]) >= 0)
    before = Window.partitionBy("_k").orderBy(way("_s")).rowsBetween(Window.unboundedPreceding, -1)
    handed = of_slice.select("_k", "_s", F.last("_best", ignorenulls=True).over(before).alias("_handed"))
    so_far = Window.partitionBy("_key", "_slice").orderBy(*map(way, at)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = stream.withColumn("_within", F.last("_right", ignorenulls=True).over(so_far))
    met = within.join(handed.hint("merge"), (F.col("_key") == F.col("_k")) & (F.col("_slice") == F.col("_s")), "left")
    return met.select(*[c for c in stream.columns if c != "_slice"], F.coalesce("_within", "_handed").alias(into))


def _picked(rows: DataFrame, own: list[str], payload: list[str], prefix: str, how: str) -> DataFrame:
    rows = rows.filter("_left is not null")
    if how == "inner":
        rows = rows.filter("_found is not null")
    return rows.select(*[F.col(f"_left.{c}").alias(c) for c in own], *[F.col(f"_found.{c}").alias(prefix + c) for c in payload])


def asof_backward(left: DataFrame, right: DataFrame, key: str, prefix: str, how: str = "inner", slice_ms: int = SLICE_MS) -> DataFrame:
    """Of each left row the last right row at or before it. ``right`` may have a ``tie`` that orders equal times."""
    stream, own, payload = _stream(left, right, key, 0, left_first=False)
    return _picked(_carried(stream, "_found", False, slice_ms), own, payload, prefix, how)


def asof_forward(left: DataFrame, right: DataFrame, key: str, prefix: str, horizon: int = 0, how: str = "inner", slice_ms: int = SLICE_MS) -> DataFrame:
    """Of each left row the first right row at or after its time plus ``horizon``; of equal times the one with the smallest tie."""
    stream, own, payload = _stream(left, right, key, horizon, left_first=True)
    return _picked(_carried(stream, "_found", True, slice_ms), own, payload, prefix, how)


def asof_nearest(left: DataFrame, right: DataFrame, key: str, prefix: str, slice_ms: int = SLICE_MS) -> DataFrame:
    """Of each left row the right row nearest in time; of two equally near the later one. Null where the key has none."""
    stream, own, payload = _stream(left, right, key, 0, left_first=False)
    rows = _carried(_carried(stream, "_before", False, slice_ms), "_after", True, slice_ms)
    nearer = (F.col("_after.ts_ms") - F.col("_at")) <= (F.col("_at") - F.col("_before.ts_ms"))
    found = F.when(F.col("_before").isNull() | nearer, F.coalesce("_after", "_before")).otherwise(F.col("_before"))
    return _picked(rows.withColumn("_found", found), own, payload, prefix, "left")


def prefix_window_sum(value: Column, keys: list[str], window_ms: int, tie: str = "tie", peers: bool = False) -> Column:
    """Sum over the closed window [ts_ms - window_ms, ts_ms], of rows at or before the current one in (ts_ms, tie), or with its ``peers``, all rows of its time.

    A difference of two running sums, since a range frame would also count later rows of equal time, and one that
    begins anywhere but at the first row would be read anew for each row.
    """
    if peers:
        so_far = Window.partitionBy(*keys).orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        so_far = Window.partitionBy(*keys).orderBy("ts_ms", tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gone = Window.partitionBy(*keys).orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, -(window_ms + 1))
    return F.sum(value).over(so_far) - F.coalesce(F.sum(value).over(gone), F.lit(0))


def sliced(rows: DataFrame, key: str, reach_ms: int, slice_ms: int | None = None, parts: int | None = None) -> DataFrame:
    """Rows dealt by key and ``_slice``; each also goes to the slices that begin within ``reach_ms`` after it. ``_own``: it is at home there.

    By default a slice is four times the reach, so a quarter of the rows travel twice. ``parts``: how many tasks share
    the slices, where a shuffle's usual number would give each too much.
    """
    width = slice_ms or 4 * reach_ms
    home, last = (F.floor((F.col("ts_ms") + ms) / width) for ms in (0, reach_ms))
    dealt = rows.withColumn("_home", home).withColumn("_slice", F.explode_outer(F.sequence("_home", last)))
    return dealt.withColumn("_own", F.col("_slice").eqNullSafe(F.col("_home"))).drop("_home").repartition(*([parts] if parts else []), key, "_slice")


def own_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("_own").drop("_own", "_slice")


def rolling_sums(rows: DataFrame, key: str, sums: dict[str, Column], windows: dict[str, int], tie: str = "tie", slice_ms: int | None = None, peers: bool = False) -> DataFrame:
    """``{sum}_{window}`` over the closed window before each row, per key; of rows at its own time those up to it by ``tie``, or with ``peers`` all."""
    held = sliced(rows, key, max(windows.values()), slice_ms)
    added = {f"{name}_{w}": prefix_window_sum(c, [key, "_slice"], ms, tie, peers) for name, c in sums.items() for w, ms in windows.items()}
    return own_rows(held.withColumns(added))


def window_firsts_and_extremes(rows: DataFrame, keys: list[str], window_ms: int, tie: str, first: list[str], extremes: dict[str, tuple[Callable, str]], gaps: bool = True) -> DataFrame:
    """``_first``, columns ``first`` of the closed window's first row; ``_{name}``, an extreme of a column over the window; ``_min_gap``, the least time between its neighbours, if ``gaps``.

    The row before the window's first is the last one that a running frame up to the window's edge has met; it knows
    its successor, and the successor knows the extremes from itself to the end of its block. What the current block
    adds is a running extreme. A window that begins in the current block holds all of that block up to the row.
    """
    step = Window.partitionBy(*keys).orderBy("ts_ms", tie)
    block = Window.partitionBy(*keys, "_block")
    up, down = (block.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow) for order in ((F.asc("ts_ms"), F.asc(tie)), (F.desc("ts_ms"), F.desc(tie))))
    gap, until = F.min, Window.partitionBy(*keys).orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, -(window_ms + 1))
    rows = rows.withColumn("_block", F.floor(F.col("ts_ms") / window_ms))
    rows = rows.withColumns({"_after": F.lead("ts_ms").over(step) - F.col("ts_ms")})
    rows = rows.withColumns({"_before": F.when(F.lag("ts_ms").over(block.orderBy("ts_ms", tie)).isNotNull(), F.col("ts_ms") - F.lag("ts_ms").over(block.orderBy("ts_ms", tie)))})
    so_far = {name: f(c).over(up) for name, (f, c) in extremes.items()} | ({"min_gap": gap("_before").over(up)} if gaps else {})
    to_end = {name: f(c).over(down) for name, (f, c) in extremes.items()} | ({"min_gap": gap("_after").over(down)} if gaps else {})
    rows = rows.withColumns({f"_up_{n}": c for n, c in so_far.items()} | {f"_down_{n}": c for n, c in to_end.items()})
    own = F.struct("_block", *first, *[f"_down_{n}" for n in to_end])
    rows = rows.withColumn("_here", own).withColumn("_next", F.lead("_here").over(step))
    whole = step.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_first", F.coalesce(F.last("_next").over(until), F.first("_here").over(whole)))
    across = F.col("_first._block") < F.col("_block")
    least = {n: F.least if n == "min_gap" or extremes[n][0] is F.min else F.greatest for n in to_end}
    joined = {f"_{n}": least[n](F.col(f"_up_{n}"), F.when(across, F.col(f"_first._down_{n}"))) for n in to_end}
    return rows.withColumns(joined).drop("_block", "_after", "_before", "_here", "_next", *[f"_{way}_{n}" for way in ("up", "down") for n in to_end])


def _handed_over(rows: DataFrame, key: str, value: Column, tie: str, slice_ms: int, strictly: bool) -> DataFrame:
    """``_found``: the last known value up to a row (before it, if ``strictly``) of its key. A slice gets it from a table of slices where it has none."""
    order = [F.asc("ts_ms"), F.asc(tie)]
    held = rows.withColumn("_value", value).withColumn("_slice", F.floor(F.col("ts_ms") / slice_ms)).repartition(key, "_slice")
    known = F.when(F.col("_value").isNotNull(), F.struct("ts_ms", tie))
    of_slice = held.groupBy(key, "_slice").agg(F.max_by("_value", known).alias("_last"))
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = of_slice.select(F.col(key).alias("_k"), F.col("_slice").alias("_s"), F.last("_last", ignorenulls=True).over(earlier).alias("_handed"))
    inside = Window.partitionBy(key, "_slice").orderBy(*order)
    here = F.lag("_value").over(inside) if strictly else F.last("_value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.col(key).eqNullSafe(F.col("_k")) & F.col("_slice").eqNullSafe(F.col("_s"))
    met = held.withColumn("_within", here).join(ends.hint("merge"), same, "left")
    return met.withColumn("_found", F.coalesce("_within", "_handed")).drop("_value", "_slice", "_k", "_s", "_within", "_handed")


def with_previous(rows: DataFrame, key: str, columns: list[str], tie: str = "tie", slice_ms: int = SLICE_MS) -> DataFrame:
    """``_previous``: the columns of the key's row before, by (ts_ms, tie), however long ago."""
    return _handed_over(rows, key, F.struct(*columns), tie, slice_ms, True).withColumnRenamed("_found", "_previous")


def with_last_known(rows: DataFrame, key: str, value: Column, into: str, tie: str = "tie", slice_ms: int = SLICE_MS) -> DataFrame:
    """``into``: the key's last value that is not null up to and with the row, by (ts_ms, tie)."""
    return _handed_over(rows, key, value, tie, slice_ms, False).withColumnRenamed("_found", into)


def leakage_count(rows: DataFrame, at: str, *features: str) -> DataFrame:
    """How many rows use a feature from after their own time."""
    return rows.agg(F.count_if(F.greatest(*features) > F.col(at)).alias("violations"), F.count(F.lit(1)).alias("n"))
