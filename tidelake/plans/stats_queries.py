"""Evaluation queries: ranking metrics, calibration, drift, thresholds, benchmark tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.functions import market
from tidelake.operators import ordered, stats
from tidelake.plans import adapters as v
from tidelake.plans.registry import query
from tidelake.session import table

_GRID = [round(0.05 * i, 2) for i in range(1, 20)]
_GRID_SQL = "[" + ", ".join(f"{x}::double" for x in _GRID) + "]"


@query("q_A05_pr_auc_optimistic", v.with_views("WITH r AS (SELECT scenario, y, row_number() OVER w AS i, sum(y::int) OVER (w ROWS UNBOUNDED PRECEDING) AS tp FROM v_scores WINDOW w AS (PARTITION BY scenario ORDER BY p DESC, y DESC)) SELECT scenario, round(coalesce(avg(tp / i) FILTER (y), 0), 9) AS pr_auc FROM r GROUP BY scenario"))
def pr_auc_optimistic(spark, sf):
    return stats.pr_auc_optimistic(v.scores(spark, sf), ["scenario"]).withColumn("pr_auc", F.round("pr_auc", 9))


@query("q_A06_pr_auc_grouped", v.with_views("WITH g AS (SELECT scenario, p, count(*) AS n, sum(y::int) AS pos FROM v_scores GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS tp FROM g WINDOW w AS (PARTITION BY scenario ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) SELECT scenario, round(CASE WHEN sum(pos) > 0 AND sum(pos) < sum(n) THEN sum(pos * tp / seen) / sum(pos) END, 9) AS pr_auc FROM c GROUP BY scenario"))
def pr_auc_grouped(spark, sf):
    return stats.pr_auc_grouped(v.scores(spark, sf), ["scenario"]).withColumn("pr_auc", F.round("pr_auc", 9))


@query("q_A07_auroc", v.with_views("WITH r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS k FROM v_scores) SELECT round((sum(k) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 9) AS auroc FROM r"))
def auroc(spark, sf):
    return stats.auroc(v.scores(spark, sf)).withColumn("auroc", F.round("auroc", 9))


@query("q_A08_f1", v.with_views("SELECT scenario, round(coalesce(2 * count(*) FILTER (p >= 0.5 AND y) / nullif(2 * count(*) FILTER (p >= 0.5 AND y) + count(*) FILTER (p >= 0.5 AND NOT y) + count(*) FILTER (p < 0.5 AND y), 0), 0), 9) AS f1 FROM v_scores GROUP BY scenario"))
def f1(spark, sf):
    return v.scores(spark, sf).groupBy("scenario").agg(F.round(stats.f1(0.5), 9).alias("f1"))


@query("q_A09_precision_at_k", v.with_views("SELECT round(avg(y::int), 9) AS precision FROM (SELECT y FROM v_scores ORDER BY p DESC, y DESC LIMIT 50)"))
def precision_at_k(spark, sf):
    return stats.precision_at(v.scores(spark, sf), 50).withColumn("precision", F.round("precision", 9))


@query("q_A10_brier_log_loss", v.with_views("SELECT scenario, round(avg((p - y::int) ** 2), 9) AS brier, round(avg(CASE WHEN y THEN -ln(greatest(least(p, 1 - 1e-7), 1e-7)) ELSE -ln(1 - greatest(least(p, 1 - 1e-7), 1e-7)) END), 9) AS log_loss FROM v_scores GROUP BY scenario"))
def brier_log_loss(spark, sf):
    return v.scores(spark, sf).groupBy("scenario").agg(F.round(stats.brier(), 9).alias("brier"), F.round(stats.log_loss(), 9).alias("log_loss"))


@query("q_A11_reliability", v.with_views("SELECT least(floor(p * 10), 9)::int AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(y::int), 9) AS rate FROM v_scores GROUP BY 1"))
def reliability(spark, sf):
    return stats.reliability(v.scores(spark, sf)).select("bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("rate", 9).alias("rate"))


@query("q_A12_calibration_error", v.with_views("WITH b AS (SELECT scenario, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y::int) AS r FROM v_scores GROUP BY ALL) SELECT scenario, round(sum(n * abs(mp - r)) / sum(n), 9) AS ece FROM b GROUP BY scenario"))
def calibration_error(spark, sf):
    return stats.calibration_error(v.scores(spark, sf), keys=["scenario"]).withColumn("ece", F.round("ece", 9))


@query("q_A14_harm_estimation", v.with_views("WITH r AS (SELECT abs(p - (markout + 20) / 40) AS e, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS a, rank() OVER (ORDER BY markout) + (count(*) OVER (PARTITION BY markout) - 1) / 2 AS b FROM v_scores) SELECT round(corr(a, b), 9) AS spearman, round(avg(e), 9) AS mae FROM r"))
def harm_estimation(spark, sf):
    return stats.spearman(v.scores(spark, sf).withColumn("harm", (F.col("markout") + 20) / 40), "p", "harm").select(F.round("spearman", 9).alias("spearman"), F.round("mae", 9).alias("mae"))


@query("q_A15_session_classification", v.with_views("WITH s AS (SELECT doc_id % 97 AS session, max(p) AS p, bool_or(y) AS y FROM v_scores GROUP BY 1), r AS (SELECT y, p, row_number() OVER w AS i, sum(y::int) OVER (w ROWS UNBOUNDED PRECEDING) AS tp FROM s WINDOW w AS (ORDER BY p DESC, y DESC)) SELECT round(coalesce(avg(tp / i) FILTER (y), 0), 9) AS pr_auc, round(coalesce(2 * count(*) FILTER (p >= 0.5 AND y) / nullif(2 * count(*) FILTER (p >= 0.5 AND y) + count(*) FILTER (p >= 0.5 AND NOT y) + count(*) FILTER (p < 0.5 AND y), 0), 0), 9) AS f1 FROM r"))
def session_classification(spark, sf):
    """Sessions by their highest score and any unsafe event."""
    sessions = v.scores(spark, sf).groupBy(F.expr("doc_id % 97").alias("session")).agg(F.max("p").alias("p"), F.bool_or("y").alias("y"))
    return stats.pr_auc_optimistic(sessions).crossJoin(sessions.agg(F.round(stats.f1(0.5), 9).alias("f1"))).select(F.round("pr_auc", 9).alias("pr_auc"), "f1")  # one row each


@query("q_A16_early_warning", v.with_views("WITH s AS (SELECT doc_id % 97 AS session, max(ts_ms) FILTER (y) AS impact, min(ts_ms) FILTER (y AND p >= 0.5) AS warned FROM v_scores GROUP BY 1) SELECT round(coalesce(sum(greatest(impact - warned, 0)), 0) / greatest(count(warned), 1), 6) AS mean_lead_time_ms, count(warned) AS sessions_warned FROM s"))
def early_warning(spark, sf):
    """Time from the first warned unsafe event to the last unsafe one, per session with a warning."""
    sessions = v.scores(spark, sf).groupBy(F.expr("doc_id % 97").alias("session")).agg(F.max(F.when(F.col("y"), F.col("ts_ms"))).alias("impact"), F.min(F.when(F.col("y") & (F.col("p") >= 0.5), F.col("ts_ms"))).alias("warned"))
    lead = F.coalesce(F.sum(F.greatest(F.col("impact") - F.col("warned"), F.lit(0))), F.lit(0)) / F.greatest(F.count("warned"), F.lit(1))
    return sessions.agg(F.round(lead, 6).alias("mean_lead_time_ms"), F.count("warned").alias("sessions_warned"))


@query("q_A17_sequence_lead_time", v.with_views("WITH s AS (SELECT doc_id % 97 AS session, max(ts_ms) AS impact, bool_or(y) AS unsafe, min(ts_ms) FILTER (p >= 0.5) AS warned FROM v_scores GROUP BY 1) SELECT round(coalesce(sum(greatest(impact - warned, 0)) FILTER (unsafe AND warned IS NOT NULL), 0) / greatest(count(*) FILTER (unsafe AND warned IS NOT NULL), 1), 6) AS lead_time_ms FROM s"))
def sequence_lead_time(spark, sf):
    sessions = v.scores(spark, sf).groupBy(F.expr("doc_id % 97").alias("session")).agg(F.max("ts_ms").alias("impact"), F.bool_or("y").alias("unsafe"), F.min(F.when(F.col("p") >= 0.5, F.col("ts_ms"))).alias("warned"))
    warned = sessions.filter("unsafe and warned is not null")
    return warned.agg(F.round(F.coalesce(F.sum(F.greatest(F.col("impact") - F.col("warned"), F.lit(0))), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("lead_time_ms"))


@query("q_A18_false_blocks", v.with_views("SELECT round(100000 * count(*) FILTER (NOT y AND p >= 0.8) / greatest(count(*) FILTER (NOT y), 1), 6) AS false_blocks_per_100k FROM v_scores"))
def false_blocks(spark, sf):
    return v.scores(spark, sf).agg(F.round(100000 * F.count_if(~F.col("y") & (F.col("p") >= 0.8)) / F.greatest(F.count_if(~F.col("y")), F.lit(1)), 6).alias("false_blocks_per_100k"))


@query("q_A20_block_threshold", v.with_views("WITH c AS (SELECT DISTINCT p AS t FROM v_scores UNION SELECT 1.1::double), b AS (SELECT t, (SELECT count(*) FROM v_scores s WHERE NOT s.y AND s.p >= c.t) AS blocked FROM c) SELECT max(t) AS threshold FROM b WHERE 100000 * blocked / (SELECT greatest(count(*), 1) FROM v_scores WHERE NOT y) <= 1000"))
def block_threshold(spark, sf):
    """The highest candidate within the budget of false blocks. As 1.1 blocks nothing and is a candidate, it always wins."""
    return stats.block_threshold(v.scores(spark, sf), 1000)


_SPLIT = "2024-01-16"


def _samples(spark, sf):
    rows = table(spark, sf, "events").select("value", (F.col("ts") < F.to_timestamp_ntz(F.lit(_SPLIT))).alias("ref"))
    return rows.filter("ref"), rows.filter("not ref")


@query("q_A21_psi", f"""WITH r AS (SELECT value FROM events WHERE ts < timestamp '{_SPLIT}'), c AS (SELECT value FROM events WHERE ts >= timestamp '{_SPLIT}'), e AS (SELECT quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM r),
b AS (SELECT unnest(generate_series(0, 9)) AS bin), rb AS (SELECT len(list_filter(edges, lambda x: x <= value)) AS bin, count(*) AS n FROM r, e GROUP BY 1), cb AS (SELECT len(list_filter(edges, lambda x: x <= value)) AS bin, count(*) AS n FROM c, e GROUP BY 1),
s AS (SELECT greatest(coalesce(rb.n, 0) / (SELECT count(*) FROM r), 1e-6) AS x, greatest(coalesce(cb.n, 0) / (SELECT count(*) FROM c), 1e-6) AS y FROM b LEFT JOIN rb USING (bin) LEFT JOIN cb ON cb.bin = b.bin) SELECT round(sum((y - x) * ln(y / x)), 9) AS psi FROM s""")  # fmt: skip
def psi(spark, sf):
    return stats.psi(*_samples(spark, sf), "value").withColumn("psi", F.round("psi", 9))


@query("q_A22_ks", f"""WITH u AS (SELECT value AS v, count(*) FILTER (ts < timestamp '{_SPLIT}') AS r, count(*) FILTER (ts >= timestamp '{_SPLIT}') AS c FROM events GROUP BY 1), k AS (SELECT sum(r) OVER w / sum(r) OVER () - sum(c) OVER w / sum(c) OVER () AS d FROM u WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)) SELECT round(max(abs(d)), 9) AS ks FROM k""")
def ks(spark, sf):
    return stats.ks(*_samples(spark, sf), "value").withColumn("ks", F.round("ks", 9))


@query("q_A23_p95_exclusive", """WITH a AS (SELECT user_id % 20 AS g, list_sort(list(value)) AS l, count(*) AS n FROM events GROUP BY 1), j AS (SELECT *, least(greatest((19 * (n + 1)) // 20, 1), n - 1) AS j FROM a) SELECT g, round((l[j] * (20 - (19 * (n + 1) - 20 * j)) + l[j + 1] * (19 * (n + 1) - 20 * j)) / 20, 6) AS p95 FROM j""")
def p95_exclusive(spark, sf):
    rows = table(spark, sf, "events").select(F.expr("user_id % 20").alias("g"), "value")
    return stats.exclusive_p95_of(rows, "value", ["g"]).select("g", F.round("p95", 6).alias("p95"))


@query("q_A24_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def percentiles(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "value")
    exact = ordered.percentiles(rows, "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["event_type"])
    means = rows.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return means.join(exact, "event_type").select("event_type", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")], "mean")


_FOLD_SQL = "f AS (SELECT *, (ntile(4) OVER (ORDER BY ts_ms) - 1)::int AS fold FROM v_scores)"


@query("q_A25_fold_report", v.with_views(f"""WITH {_FOLD_SQL} SELECT fold, count(*) AS n_test, round(avg((p - y::int) ** 2), 9) AS brier, round(avg(markout), 9) AS baseline_markout, round(sum(CASE WHEN p < 0.5 THEN markout ELSE 0 END) / count(*), 9) AS policy_markout,
round(sum(CASE WHEN p < 0.5 THEN markout ELSE 0 END) / count(*) - avg(markout), 9) AS lift, round(avg((p < 0.5)::int), 9) AS quote_rate FROM f GROUP BY fold"""))  # fmt: skip
def fold_report(spark, sf):
    """Per fold: skipped rows earn nothing but count in the denominator."""
    policy = F.sum(F.when(F.col("p") < 0.5, F.col("markout")).otherwise(0.0)) / F.count(F.lit(1))
    return stats.with_folds(v.scores(spark, sf), 4, ["ts_ms"]).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_test"), F.round(stats.brier(), 9).alias("brier"), F.round(F.avg("markout"), 9).alias("baseline_markout"), F.round(policy, 9).alias("policy_markout"), F.round(policy - F.avg("markout"), 9).alias("lift"), F.round(F.avg((F.col("p") < 0.5).cast("int")), 9).alias("quote_rate")
    )


@query("q_A26_report_rollup", v.with_views(f"WITH {_FOLD_SQL}, r AS (SELECT fold, count(*) AS n, avg((p - y::int) ** 2) AS brier FROM f GROUP BY fold) SELECT round(sum(brier * n) / sum(n), 9) AS brier, sum(n)::bigint AS n_test FROM r WHERE NOT isnan(brier)"))
def report_rollup(spark, sf):
    folds = stats.with_folds(v.scores(spark, sf), 4, ["ts_ms"]).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), stats.brier().alias("brier"))
    return folds.filter(~F.isnan("brier")).agg(F.round(F.sum(F.col("brier") * F.col("n")) / F.sum("n"), 9).alias("brier"), F.sum("n").alias("n_test"))


_SWEEP_SQL = f"""g AS (SELECT unnest({_GRID_SQL}) AS threshold), w AS (SELECT KEYS threshold, sum((p < threshold)::int) / count(*) AS quote_rate, sum(CASE WHEN p < threshold THEN markout ELSE 0 END) / count(*) AS policy, sum(CASE WHEN p < threshold THEN markout ELSE 0 END) / count(*) - avg(markout) AS lift FROM SOURCE, g GROUP BY ALL)"""


@query("q_A27_threshold_sweep", v.with_views("WITH " + _SWEEP_SQL.replace("KEYS", "").replace("SOURCE", "v_scores") + " SELECT threshold, round(quote_rate, 9) AS quote_rate, round(policy, 9) AS policy_markout, round(lift, 9) AS lift FROM w"))
def threshold_sweep(spark, sf):
    return stats.threshold_sweep(v.scores(spark, sf), _GRID).select("threshold", *[F.round(c, 9).alias(c) for c in ("quote_rate", "policy_markout", "lift")])


_PICK_SQL = "arg_max(struct_pack(t := threshold, l := lift, q := quote_rate, e := quote_rate BETWEEN 0.2 AND 0.95), (quote_rate BETWEEN 0.2 AND 0.95, round(lift, 9), -abs(round(quote_rate, 9) - 0.575), -threshold))"


@query("q_A27_threshold_select", v.with_views("WITH " + _SWEEP_SQL.replace("KEYS", "").replace("SOURCE", "v_scores") + f", b AS (SELECT {_PICK_SQL} AS b FROM w) SELECT b.t AS threshold, round(b.l, 9) AS lift, round(b.q, 9) AS quote_rate, b.e AS eligible FROM b"))
def threshold_select(spark, sf):
    sweep = stats.threshold_sweep(v.scores(spark, sf), _GRID).withColumns({"lift": F.round("lift", 9), "quote_rate": F.round("quote_rate", 9)})
    return stats.select_threshold(sweep, 0.2, 0.95)


@query("q_A28_fold_thresholds", v.with_views(f"WITH {_FOLD_SQL}, o AS (SELECT b.fold AS held, f.* FROM f, (SELECT DISTINCT fold FROM f) b WHERE f.fold <> b.fold), " + _SWEEP_SQL.replace("KEYS", "held,").replace("SOURCE", "o") + f", b AS (SELECT held, {_PICK_SQL} AS b FROM w GROUP BY held) SELECT held AS fold, b.t AS threshold, round(b.l, 9) AS lift, b.e AS eligible FROM b"))
def fold_thresholds(spark, sf):
    """For each fold the threshold chosen on all other folds: counts per fold and grid place, then the other folds' sum."""
    folded = stats.with_folds(v.scores(spark, sf), 4, ["ts_ms"])
    first = F.size(F.filter(F.array(*map(F.lit, _GRID)), lambda t: t <= F.col("p")))
    cells = folded.groupBy("fold", first.alias("i")).agg(F.sum("markout").alias("gain"), F.count(F.lit(1)).alias("n"))
    held = folded.select(F.col("fold").alias("held")).distinct()
    grid = spark.createDataFrame(list(enumerate(_GRID)), "at int, threshold double")
    others = cells.join(F.broadcast(held), F.col("fold") != F.col("held")).join(F.broadcast(grid))  # folds x grid places, squared at most
    quoted = F.col("i") <= F.col("at")
    sums = others.groupBy("held", "threshold").agg((F.sum(F.when(quoted, F.col("n")).otherwise(0)) / F.sum("n")).alias("quote_rate"), F.sum(F.when(quoted, F.col("gain")).otherwise(0.0)).alias("g"), F.sum("gain").alias("all"), F.sum("n").alias("n"))
    sweep = sums.select(F.col("held").alias("fold"), "threshold", F.round("quote_rate", 9).alias("quote_rate"), F.round(F.col("g") / F.col("n") - F.col("all") / F.col("n"), 9).alias("lift"))
    return stats.select_threshold(sweep, 0.2, 0.95, ["fold"]).select("fold", "threshold", "lift", "eligible")


@query("q_A29_metric_deltas", v.with_views("WITH m AS (SELECT 'brier' AS metric, avg((p - y::int) ** 2) AS c, avg((0.5 - y::int) ** 2) AS b FROM v_scores UNION ALL SELECT 'quote_rate', avg((p < 0.5)::int), 1.0 FROM v_scores) SELECT metric, round(c - b, 9) AS delta FROM m"))
def metric_deltas(spark, sf):
    rows = v.scores(spark, sf)
    one = rows.agg(stats.brier().alias("brier"), F.avg((F.col("p") < 0.5).cast("int")).alias("quote_rate")).unpivot([], ["brier", "quote_rate"], "metric", "candidate")
    two = rows.withColumn("p", F.lit(0.5)).agg(stats.brier().alias("brier"), F.lit(1.0).alias("quote_rate")).unpivot([], ["brier", "quote_rate"], "metric", "baseline")
    return one.join(two, "metric").select("metric", F.round(F.col("candidate") - F.col("baseline"), 9).alias("delta"))


@query("q_A30_partition_row_counts", v.with_views("SELECT coin, ts_ms // 86400000 AS day, count(*) AS n FROM v_fills GROUP BY ALL"))
def partition_row_counts(spark, sf):
    return v.fills(spark, sf).groupBy("coin", F.expr("ts_ms div 86400000").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("q_A35_feature_distance", """WITH e AS (SELECT vec_id, label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), s AS (SELECT k, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS d FROM e WHERE label < 5 GROUP BY k)
SELECT vec_id, round(avg(abs((x - m) / d)), 6) AS score FROM e JOIN s USING (k) WHERE label >= 5 GROUP BY vec_id""")  # fmt: skip
def feature_distance(spark, sf):
    """Mean absolute z-score of a row's features against the known families' mean and deviation (a constant one counts 1)."""
    long = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "x")).withColumn("x", F.col("x").cast("double"))
    known = long.filter("label < 5").groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("d")).withColumn("d", F.when(F.col("d") == 0, 1.0).otherwise(F.col("d")))
    return long.filter("label >= 5").join(F.broadcast(known), "k").groupBy("vec_id").agg(F.round(F.avg(F.abs((F.col("x") - F.col("m")) / F.col("d"))), 6).alias("score"))


@query("q_A43_splits", v.with_views("""WITH s AS (SELECT DISTINCT scenario_id, sha256(scenario_id::varchar) AS h FROM v_orders), b AS (SELECT scenario_id, (6 * list_sum(list_transform(string_split(h[:63], ''), lambda c: ('0x' || c)::int)) + ('0x' || h[64])::int) % 10 AS k FROM s)
SELECT o.split, count(*) AS n FROM (SELECT CASE WHEN k < 6 THEN 'train' WHEN k < 8 THEN 'validation' ELSE 'test' END AS split FROM v_orders JOIN b USING (scenario_id)) o GROUP BY 1"""))  # fmt: skip
def splits(spark, sf):
    return v.orders(spark, sf).groupBy(stats.split_name(stats.scenario_bucket("scenario_id")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("q_P21_ofi_baseline", v.with_views("SELECT tid, round(0.5 + 0.5 * ((exp(2 * x) - 1) / (exp(2 * x) + 1)), 9) AS p FROM (SELECT tid, -(CASE WHEN coalesce(crossed, false) THEN -1 ELSE 1 END * CASE side WHEN 'B' THEN 1 ELSE -1 END) * (sz / 500 - 0.5) AS x FROM v_fills)"))
def ofi_baseline(spark, sf):
    return v.fills(spark, sf).select("tid", F.round(0.5 + 0.5 * F.tanh(-(market.maker_side() * (F.col("sz") / 500 - 0.5))), 9).alias("p"))


_X, _Y = [0.1, 0.4, 0.6, 0.9], [0.05, 0.3, 0.7, 0.8]


@query("q_P22_isotonic", v.with_views("SELECT doc_id, round(CASE WHEN p <= 0.1 THEN 0.05 WHEN p <= 0.4 THEN 0.05 + (p - 0.1) * (0.25 / 0.3) WHEN p <= 0.6 THEN 0.3 + (p - 0.4) * (0.4 / 0.2) WHEN p <= 0.9 THEN 0.7 + (p - 0.6) * (0.1 / 0.3) ELSE 0.8 END, 6) AS calibrated FROM v_scores"))
def isotonic(spark, sf):
    return v.scores(spark, sf).select("doc_id", F.round(market.interpolated(F.col("p"), _X, _Y), 6).alias("calibrated"))
