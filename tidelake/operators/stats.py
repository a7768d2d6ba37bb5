"""Evaluation aggregates over scored rows (p, y): ranking metrics, calibration, drift, thresholds.

Where the result only depends on distinct scores, rows are first grouped by score. Running sums over scores
or rows go by parts (see ``ordered``), so that neither is ever one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.operators import ordered


def _by_score(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("pos"))


def pr_auc_grouped(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Average precision with tied scores taken as one step; null with a single class."""
    keys = keys or []
    steps = ordered.running(_by_score(rows, keys), "p", {"tp": F.col("pos"), "seen": F.col("n")}, keys, descending=True)
    out = steps.groupBy(*keys).agg(F.sum("pos").alias("positives"), F.sum("n").alias("n"), F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("area"))
    return out.select(*keys, F.when((F.col("positives") > 0) & (F.col("positives") < F.col("n")), F.col("area") / F.col("positives")).alias("pr_auc"))


def pr_auc_optimistic(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Average precision with positives first among tied scores; 0 without positives.

    Of a score with ``pos`` positives after ``tp`` of ``seen`` rows, the sum of (tp + i) / (seen + i) for i = 1..pos.
    """
    keys = keys or []
    steps = ordered.running(_by_score(rows, keys), "p", {"tp": F.col("pos"), "seen": F.col("n")}, keys, descending=True)
    steps = steps.withColumns({"tp": F.col("tp") - F.col("pos"), "seen": F.col("seen") - F.col("n")})
    step = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("pos")), F.lit(0.0), lambda a, i: a + (F.col("tp") + i) / (F.col("seen") + i))
    out = steps.groupBy(*keys).agg(F.sum("pos").alias("positives"), F.sum(F.when(F.col("pos") > 0, step).otherwise(0.0)).alias("area"))
    return out.select(*keys, F.when(F.col("positives") > 0, F.col("area") / F.col("positives")).otherwise(0.0).alias("pr_auc"))


def auroc(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by average ranks; 0 with a single class."""
    keys = keys or []
    ranked = ordered.running(_by_score(rows, keys), "p", {"upto": F.col("n")}, keys).withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum("pos").alias("positives"), F.sum(F.col("n") - F.col("pos")).alias("negatives"), F.sum(F.col("rank") * F.col("pos")).alias("ranks"))
    area = (F.col("ranks") - F.col("positives") * (F.col("positives") + 1) / 2) / (F.col("positives") * F.col("negatives"))
    return sums.select(*keys, F.when((F.col("positives") > 0) & (F.col("negatives") > 0), area).otherwise(0.0).alias("auroc"))


def f1(threshold: float) -> Column:
    """F1 of the rule p >= threshold, as an aggregate."""
    hit = F.col("p") >= threshold
    tp, fp, fn = F.count_if(hit & F.col("y")), F.count_if(hit & ~F.col("y")), F.count_if(~hit & F.col("y"))
    return F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0))


def precision_at(rows: DataFrame, k: int) -> DataFrame:
    """Share of positives among the k highest scores, positives first among ties."""
    return rows.orderBy(F.desc("p"), F.desc("y")).limit(k).agg(F.avg(F.col("y").cast("double")).alias("precision"))


def brier() -> Column:
    return F.avg(F.pow(F.col("p") - F.col("y").cast("double"), 2))


def log_loss(clip: float = 1e-7) -> Column:
    p = F.least(F.greatest(F.col("p"), F.lit(clip)), F.lit(1 - clip))
    return F.avg(F.when(F.col("y"), -F.log(p)).otherwise(-F.log(1 - p)))


def reliability(rows: DataFrame, bins: int = 10, keys: list[str] | None = None) -> DataFrame:
    """Non-empty calibration bins: count, mean score, share of positives."""
    index = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*(keys or []), index.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate"))


def calibration_error(rows: DataFrame, bins: int = 10, keys: list[str] | None = None) -> DataFrame:
    """Expected calibration error, from the bins alone."""
    return reliability(rows, bins, keys).groupBy(*(keys or [])).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation, and the mean absolute error of x against y; 0 where either doesn't vary. Ranks meet pairs of values, not rows."""
    pairs = rows.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    for c in ("x", "y"):
        ranks = ordered.average_ranks(rows, x if c == "x" else y)
        pairs = pairs.join(ranks.select(F.col("value").alias(c), (F.col("rank") - (F.col("upto_all") + 1) / 2).alias(f"r{c}")).hint("merge"), c)  # ranks about their mean
    total = lambda c: F.sum(F.col("n") * c)
    rx, ry = F.col("rx"), F.col("ry")
    correlation = F.try_divide(total(rx * ry), F.sqrt(total(rx * rx)) * F.sqrt(total(ry * ry)))
    return pairs.agg(F.coalesce(correlation, F.lit(0.0)).alias("spearman"), (total(F.abs(F.col("x") - F.col("y"))) / F.sum("n")).alias("mae"))


def exclusive_p95(values: Column) -> Column:
    """95th percentile by the exclusive method (positions of n + 1), from a sorted array; beyond the ends it extrapolates."""
    n = F.size(values)
    j = F.least(F.greatest(F.floor(19 * (n + 1) / 20).cast("int"), F.lit(1)), n - 1)
    d = 19 * (n + 1) - 20 * j
    between = (F.element_at(values, j) * (20 - d) + F.element_at(values, j + 1) * d) / 20
    return F.when(n == 0, F.lit(0.0)).when(n == 1, F.element_at(values, 1)).otherwise(between)


def exclusive_p95_of(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """As exclusive_p95 per key, from counts of values: no key's values are collected."""
    n = F.col("n")
    j = F.least(F.greatest(F.floor(19 * (n + 1) / 20), F.lit(1)), n - 1)
    d = 19 * (n + 1) - 20 * j
    found = ordered.nth_values(rows.filter(F.col(column).isNotNull()), column, {"_lo": j, "_hi": j + 1}, keys)
    return found.select(*keys, F.when(n == 1, F.col("_hi")).otherwise((F.col("_lo") * (20 - d) + F.col("_hi") * d) / 20).alias("p95"))


def psi(reference: DataFrame, current: DataFrame, column: str, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability index over the reference's quantile bins; an empty bin counts as ``floor``."""
    if bins < 2:
        return reference.sparkSession.range(1).select(F.lit(0.0).alias("psi"))
    edges = [i / bins for i in range(1, bins)]
    cut = ordered.percentiles(reference, column, {f"q{i}": q for i, q in enumerate(edges)}).select(F.array_distinct(F.array(*[f"q{i}" for i in range(len(edges))])).alias("edges"))
    counted = None
    for name, rows in (("ref", reference), ("cur", current)):
        binned = rows.filter(F.col(column).isNotNull()).join(F.broadcast(cut)).select(F.size(F.filter("edges", lambda e: e <= F.col(column))).alias("bin"))
        shares = binned.groupBy("bin").agg(F.count(F.lit(1)).alias(name))
        counted = shares if counted is None else counted.join(shares, "bin", "full")
    all_bins = cut.select(F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin")).join(counted, "bin", "left").fillna(0)
    totals = all_bins.agg(F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"))
    r, c = (F.greatest(F.col(x) / F.col(f"n_{x}"), F.lit(floor)) for x in ("ref", "cur"))
    return all_bins.join(F.broadcast(totals)).agg(F.sum((c - r) * F.log(c / r)).alias("psi"))


def ks(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance, over distinct values."""
    both = reference.select(F.col(column).alias("v"), F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(current.select(F.col(column).alias("v"), F.lit(0).alias("r"), F.lit(1).alias("c")))
    steps = both.groupBy("v").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    steps = ordered.running(steps, "v", {"ref": F.col("r"), "cur": F.col("c")})
    return steps.agg(F.max(F.abs(F.col("ref") / F.col("ref_all") - F.col("cur") / F.col("cur_all"))).alias("ks"))


def threshold_sweep(rows: DataFrame, grid: list[float], keys: list[str] | None = None) -> DataFrame:
    """For each threshold: quote rate, policy markout and lift of quoting where p < threshold; skipped rows earn 0.

    Rows are counted by the first threshold that quotes them, then summed up over the sorted grid: one pass, no
    rows-by-thresholds product. A null score is refused: it can be neither quoted nor withheld.
    """
    keys, grid = keys or [], sorted(grid)
    score = F.coalesce(F.col("p"), F.raise_error(F.lit("a score is null: leave such rows out, or give them a score")).cast("double"))
    first = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= score))
    groups = rows.groupBy(*keys, first.alias("i")).agg(F.sum("markout").alias("gain"), F.count(F.lit(1)).alias("n"))
    by_key = groups.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum("gain").alias("all_gain"), F.map_from_entries(F.collect_list(F.struct("i", F.struct("gain", "n")))).alias("m"))
    each = by_key.select(*keys, "total", "all_gain", "m", F.posexplode(F.array(*map(F.lit, grid))).alias("at", "threshold"))
    quoted = F.filter(F.map_entries("m"), lambda e: e["key"] <= F.col("at"))
    gain = F.aggregate(quoted, F.lit(0.0), lambda a, e: a + e["value"]["gain"])
    n = F.aggregate(quoted, F.lit(0).cast("long"), lambda a, e: a + e["value"]["n"])
    return each.select(*keys, "threshold", (n / F.col("total")).alias("quote_rate"), (gain / F.col("total")).alias("policy_markout"), (gain / F.col("total") - F.col("all_gain") / F.col("total")).alias("lift"))


def select_threshold(sweep: DataFrame, low: float, high: float, keys: list[str] | None = None) -> DataFrame:
    """Largest lift among thresholds whose quote rate is within budget (all, if none is), then nearest to mid budget, then lowest."""
    eligible = F.col("quote_rate").between(low, high)
    best = F.struct(eligible.alias("eligible"), F.col("lift"), (-F.abs(F.col("quote_rate") - (low + high) / 2)).alias("near"), (-F.col("threshold")).alias("minus"))
    picked = sweep.groupBy(*(keys or [])).agg(F.max_by(F.struct("threshold", "lift", "quote_rate", eligible.alias("eligible")), best).alias("b"))
    return picked.select(*(keys or []), "b.*")


def block_threshold(rows: DataFrame, per_100k: float, beyond: float = 1.1) -> DataFrame:
    """The highest score that as a threshold blocks at most so many of 100,000 benign rows. ``beyond`` blocks none and is a candidate too."""
    candidate = rows.sparkSession.range(1).select(F.lit(beyond).alias("p"), F.lit(0).cast("long").alias("benign"))
    by_score = rows.groupBy("p").agg(F.count_if(~F.col("y")).alias("benign")).unionByName(candidate)
    steps = ordered.running(by_score, "p", {"blocked": F.col("benign")}, descending=True)
    return steps.filter(100000 * F.col("blocked") / F.greatest("blocked_all", F.lit(1)) <= per_100k).agg(F.max("p").alias("threshold"))


def with_folds(rows: DataFrame, n: int, order: list[str], parts: int | None = None) -> DataFrame:
    """Contiguous folds by time; the first ones are a row longer where rows don't divide evenly."""
    return ordered.tiles(rows, n, order[0], order[1:], parts).withColumnRenamed("tile", "fold")


def purged_train_sizes(folded: DataFrame, purge_ms: int, embargo_ms: int) -> DataFrame:
    """Per fold its bounds, and the rows left to train on: those outside [start - purge, end + embargo]."""
    bounds = folded.groupBy("fold").agg(F.min("ts_ms").alias("start"), F.max("ts_ms").alias("end"), F.count(F.lit(1)).alias("n_test"))
    times = folded.groupBy("ts_ms").agg(F.count(F.lit(1)).alias("n"))
    outside = (F.col("ts_ms") < F.col("start") - purge_ms) | (F.col("ts_ms") > F.col("end") + embargo_ms)
    trained = times.join(F.broadcast(bounds)).filter(outside).groupBy("fold").agg(F.sum("n").alias("n_train"))  # as many bounds as folds
    return bounds.join(trained, "fold", "left").fillna(0, ["n_train"])


def scenario_bucket(column: str) -> Column:
    """sha256 of the text as a number, mod 10: a power of 16 ends in 6, so all digits but the last count 6 times."""
    digits = F.transform(F.split(F.sha2(F.col(column).cast("string"), 256), ""), lambda c: F.conv(c, 16, 10).cast("int"))
    digits = F.filter(digits, lambda d: d.isNotNull())
    return (6 * F.aggregate(F.slice(digits, 1, 63), F.lit(0), lambda a, d: a + d) + F.element_at(digits, 64)) % 10


def split_name(bucket: Column) -> Column:
    return F.when(bucket < 6, "train").when(bucket < 8, "validation").otherwise("test")


def sequence_metrics(rows: DataFrame, session: str, threshold: float = 0.5) -> DataFrame:
    """One row: PR-AUC, AUROC, F1 at the threshold, and the mean time from a session's first warning to its end."""
    sessions = rows.groupBy(session).agg(F.max("ts_ms").alias("end"), F.bool_or("y").alias("unsafe"), F.min(F.when(F.col("p") >= threshold, F.col("ts_ms"))).alias("warned"))
    lead = sessions.filter("unsafe and warned is not null").agg(F.coalesce(F.avg(F.greatest(F.col("end") - F.col("warned"), F.lit(0)).cast("double")), F.lit(0.0)).alias("lead_time_ms"))
    one = [auroc(rows), rows.agg(f1(threshold).alias("f1")), lead]
    out = pr_auc_optimistic(rows)
    for part in one:
        out = out.join(F.broadcast(part))  # one row each
    return out


def holdout(rows: DataFrame, order: list[str], share: float = 0.2) -> DataFrame:
    """The latest share of rows, in whole hundredths."""
    return ordered.tiles(rows, 100, order[0], order[1:]).filter(F.col("tile") >= round(100 * (1 - share))).drop("tile")
