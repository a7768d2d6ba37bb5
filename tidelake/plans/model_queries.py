"""Scoring, synthetic data, memories, persisted runs and the reports around models, with oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelake.functions import market
from tidelake.operators import lake, memory, policy, replay, scoring, stats, tables, temporal
from tidelake.plans import adapters as v
from tidelake.plans.policy_queries import _RULED_SQL, ruled
from tidelake.plans.registry import query
from tidelake.plans.serving_queries import _templates_sql
from tidelake.session import new_folder, table

_X, _Y = [0.1, 0.4, 0.6, 0.9], [0.05, 0.3, 0.7, 0.8]
_CALIBRATED_SQL = "CASE WHEN raw <= 0.1 THEN 0.05 WHEN raw <= 0.4 THEN 0.05 + (raw - 0.1) * (0.25 / 0.3) WHEN raw <= 0.6 THEN 0.3 + (raw - 0.4) * (0.4 / 0.2) WHEN raw <= 0.9 THEN 0.7 + (raw - 0.6) * (0.1 / 0.3) ELSE 0.8 END"


def _scorer() -> scoring.Scorer:
    """A logistic model stands for the trees; the calibrator names the columns, the policy the threshold."""
    weights = (0.02, -0.004, 0.3)
    logit = lambda x: 1 / (1 + F.exp(-(x[0] * weights[0] + x[1] * weights[1] + x[2] * weights[2] - 1.5)))
    return scoring.load_scorer(logit, {"feature_columns": ["px", "sz", "maker_side"], "x_thresholds": _X, "y_thresholds": _Y}, {"model_name": "logit", "feature_columns": ["px"], "decision_threshold": 0.9}, {"decision_threshold": 0.45})


_GOLD_SQL = f"""g AS (SELECT tid, ts_ms, px, sz, CASE WHEN coalesce(crossed, false) THEN -1 ELSE 1 END * CASE side WHEN 'B' THEN 1 ELSE -1 END AS maker_side FROM v_fills), r AS (SELECT *, 1 / (1 + exp(-(px * 0.02 + sz * -0.004 + maker_side * 0.3 - 1.5))) AS raw FROM g), c AS (SELECT *, {_CALIBRATED_SQL} AS cal FROM r)"""


@query("q_V05_scorer", v.with_views(f"WITH {_GOLD_SQL} SELECT tid, round(raw, 6) AS raw_score, round(cal, 6) AS calibrated_score, CASE WHEN cal >= 0.45 THEN 'withhold_quote' ELSE 'quote' END AS action FROM c"))
def scorer(spark, sf):
    rows = scoring.scored(v.fills(spark, sf).withColumn("maker_side", market.maker_side()), _scorer())
    return rows.select("tid", F.round("raw_score", 6).alias("raw_score"), F.round("calibrated_score", 6).alias("calibrated_score"), "action")


@query("q_V04_gold_scores", v.with_views(f"WITH {_GOLD_SQL} SELECT tid, round(cal, 6) AS calibrated_score, CASE WHEN cal >= 0.45 THEN 'withhold_quote' ELSE 'quote' END AS action, array_to_string(list_transform(list_sort([struct_pack(o := -abs(px), i := 1, k := 'px'), struct_pack(o := -abs(sz), i := 2, k := 'sz'), struct_pack(o := -1.0::double, i := 3, k := 'maker_side')]), lambda x: x.k), ',') AS top FROM (SELECT * FROM c ORDER BY ts_ms DESC, tid DESC LIMIT 100)"))
def gold_scores(spark, sf):
    """The newest 100 fills (a feature of the report) scored, with their largest features."""
    rows = scoring.score_gold(v.fills(spark, sf).withColumn("maker_side", market.maker_side()), _scorer(), limit=100)
    return rows.select("tid", F.round("calibrated_score", 6).alias("calibrated_score"), "action", F.array_join(F.transform("top_features", lambda x: x["name"]), ",").alias("top"))


@query("q_V03_decision_round_trip", v.with_views(f"WITH {_GOLD_SQL} SELECT tid, round(cal, 6) AS score, tid % 3 = 0 AS toxic FROM c"))
def decision_round_trip(spark, sf):
    """Decisions stored as JSON, as text in part, and read back as values."""
    rows = scoring.scored(v.fills(spark, sf).withColumn("maker_side", market.maker_side()), _scorer())
    stored = rows.select(F.to_json(F.struct("tid", F.round("calibrated_score", 6).cast("string").alias("score"), F.when(F.col("tid") % 3 == 0, " Yes").otherwise("no").alias("toxic"))).alias("value"))
    return stored.select(F.from_json("value", "tid bigint, score string, toxic string").alias("d")).select("d.*").select("tid", F.col("score").cast("double").alias("score"), scoring.optional_bool("toxic").alias("toxic"))


@query("q_M04_contributions", "WITH l AS (SELECT vec_id, list_transform(range(1, len(embedding) + 1), lambda i: struct_pack(o := -abs(embedding[i]::double * ((i - 1) % 7 + 1) / 8e0), i := i, s := embedding[i]::double * ((i - 1) % 7 + 1) / 8e0)) AS l FROM embeddings) SELECT vec_id, array_to_string(list_transform(list_slice(list_sort(l), 1, 3), lambda x: 'f' || x.i), ',') AS top, round(list_sort(l)[1].s, 9) AS largest FROM l")
def top_contributions(spark, sf):
    rows = table(spark, sf, "embeddings")
    top = scoring.array_contributions("embedding", lambda i: (i % 7 + 1) / 8)
    return rows.withColumn("top", top).select("vec_id", F.array_join(F.transform("top", lambda x: x["name"]), ",").alias("top"), F.round(F.col("top")[0]["share"], 9).alias("largest"))


_HOSTILE = "('spoofing_layering', 'quote_stuffing', 'momentum_ignition')"


def _numbers(spark, sf):
    """A row's number for each of the driver's bars."""
    return v.bars(spark, sf).select(F.col("tie").alias("idx"))


_PAIRS_SQL = v.with_views(f"""WITH {_templates_sql()},
t AS (SELECT scenario, n_rules > 0 AS hostile, row_number() OVER (PARTITION BY n_rules > 0 ORDER BY scenario) - 1 AS nth FROM tpl)
SELECT a.scenario, i.tie AS idx, b.scenario AS opposite, a.hostile FROM t a, v_bars i, t b WHERE a.hostile <> b.hostile AND i.tie % 3 = b.nth""")


@query("q_J19_template_pairs", _PAIRS_SQL)
def template_pairs(spark, sf):
    return replay.synthetic_features(spark, _numbers(spark, sf)).select("scenario", "idx", "opposite", "hostile")


@query("q_M03_synthetic_rows", v.with_views(f"WITH {_templates_sql()} SELECT scenario, tie AS idx, burst, cancel_rate, drift, price_range FROM tpl, v_bars"))
def synthetic_rows(spark, sf):
    """Without noise and contamination every row is its scenario's template; the draws are tested on their own."""
    return replay.synthetic_features(spark, _numbers(spark, sf), contamination=0.0, noise=0.0).select("scenario", "idx", "burst", "cancel_rate", "drift", "price_range")


@query("q_M05_holdout", v.with_views("WITH h AS (SELECT * FROM (SELECT *, ntile(100) OVER (ORDER BY ts_ms) AS t FROM v_scores) WHERE t > 80) SELECT count(*) AS n, round(avg((p - y::int) ** 2), 9) AS brier, round(sum(CASE WHEN p < 0.5 THEN markout ELSE 0 END) / count(*), 9) AS policy_markout, round(avg(markout), 9) AS baseline_markout FROM h"))
def holdout_evaluation(spark, sf):
    rows = stats.holdout(v.scores(spark, sf), ["ts_ms"])
    policy_markout = F.sum(F.when(F.col("p") < 0.5, F.col("markout")).otherwise(0.0)) / F.count(F.lit(1))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(stats.brier(), 9).alias("brier"), F.round(policy_markout, 9).alias("policy_markout"), F.round(F.avg("markout"), 9).alias("baseline_markout"))


@query("q_V24_baseline_evaluation", v.with_views("WITH b AS (SELECT *, 0.5 + 0.5 * tanh(-(markout / 20)) AS q, (ntile(4) OVER (ORDER BY ts_ms) - 1)::int AS fold FROM v_scores) SELECT fold, count(*) AS n_test, round(avg((q - y::int) ** 2), 9) AS brier, round(avg((q < 0.5)::int), 9) AS quote_rate, round(sum(CASE WHEN q < 0.5 THEN markout ELSE 0 END) / count(*) - avg(markout), 9) AS lift FROM b GROUP BY fold"))
def baseline_evaluation(spark, sf):
    """The order-flow baseline in place of the model's scores, fold by fold."""
    rows = stats.with_folds(v.scores(spark, sf).withColumn("p", 0.5 + 0.5 * F.tanh(-(F.col("markout") / 20))), 4, ["ts_ms"])
    earned = F.sum(F.when(F.col("p") < 0.5, F.col("markout")).otherwise(0.0)) / F.count(F.lit(1))
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"), F.round(stats.brier(), 9).alias("brier"), F.round(F.avg((F.col("p") < 0.5).cast("int")), 9).alias("quote_rate"), F.round(earned - F.avg("markout"), 9).alias("lift"))


@query("q_V28_sequence_metrics", v.with_views("WITH r AS (SELECT y, p, row_number() OVER w AS i, sum(y::int) OVER (w ROWS UNBOUNDED PRECEDING) AS tp, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS k FROM v_scores WINDOW w AS (ORDER BY p DESC, y DESC)), s AS (SELECT doc_id % 97 AS session, max(ts_ms) AS e, bool_or(y) AS u, min(ts_ms) FILTER (p >= 0.5) AS w FROM v_scores GROUP BY 1) SELECT round(coalesce(avg(tp / i) FILTER (y), 0), 9) AS pr_auc, round((sum(k) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 9) AS auroc, round(2 * count(*) FILTER (p >= 0.5 AND y) / (2 * count(*) FILTER (p >= 0.5 AND y) + count(*) FILTER (p >= 0.5 AND NOT y) + count(*) FILTER (p < 0.5 AND y)), 9) AS f1, (SELECT round(coalesce(avg(greatest(e - w, 0)) FILTER (u AND w IS NOT NULL), 0), 6) FROM s) AS lead_time_ms FROM r"))
def sequence_metrics(spark, sf):
    rows = stats.sequence_metrics(v.scores(spark, sf).withColumn("session", F.expr("doc_id % 97")), "session")
    return rows.select(*[F.round(c, 6 if c == "lead_time_ms" else 9).alias(c) for c in ("pr_auc", "auroc", "f1", "lead_time_ms")])


@query("q_V27_held_out_families", v.with_views("SELECT scenario, count(*) AS n, scenario IN ('de', 'fr') AS held_out FROM v_scores GROUP BY scenario"))
def held_out_families(spark, sf):
    from tidelake.operators import models

    train, test = models.family_split(v.scores(spark, sf), ["de", "fr"])
    both = train.withColumn("held_out", F.lit(False)).unionByName(test.withColumn("held_out", F.lit(True)))
    return both.groupBy("scenario", "held_out").agg(F.count(F.lit(1)).alias("n"))


def _recursive(sql: str) -> str:
    return v.with_views(sql).replace("WITH ", "WITH RECURSIVE ", 1)


@query("q_M18_running_memory", _recursive(f"""WITH {_RULED_SQL}, n AS (SELECT event_id, rules, user_id % 6 AS name FROM s), f AS (SELECT rules, name, min(event_id) AS first FROM n GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY first) AS k FROM f),
m AS (SELECT 0::bigint AS k, []::STRUCT(rules VARCHAR[], name BIGINT, first BIGINT)[] AS shelf UNION ALL SELECT o.k, CASE WHEN len(list_filter(m.shelf, lambda x: greatest(0, 1 - greatest(CASE WHEN len(o.rules) > 0 AND len(x.rules) > 0 THEN len(list_intersect(o.rules, x.rules)) / len(list_distinct(o.rules || x.rules)) ELSE 0 END, CASE WHEN o.name = x.name THEN 0.6 ELSE 0 END)) < 0.35)) = 0 THEN list_append(m.shelf, struct_pack(rules := o.rules, name := o.name::bigint, first := o.first::bigint)) ELSE m.shelf END FROM m JOIN o ON o.k = m.k + 1),
z AS (SELECT unnest(list_transform(shelf, lambda x: x.first)) AS first FROM m WHERE k = (SELECT max(k) FROM o)) SELECT event_id, len(rules) = 0 OR event_id IN (SELECT first FROM z) AS novel FROM n"""))  # fmt: skip
def running_memory(spark, sf):
    """Every case in order: remembered if it is new against what is remembered before it."""
    cases = ruled(spark, sf).select("event_id", "rules", F.expr("user_id % 6").alias("name"))
    return memory.remembered(cases, "event_id").select("event_id", "novel")


@query("q_M17_retrain_trigger", v.with_views(f"WITH {_RULED_SQL} SELECT user_id, CASE WHEN user_id % 17 = 0 THEN 'forced' WHEN user_id % 11 = 0 THEN 'pending' WHEN count(*) FILTER (severity = 'critical') >= 30 THEN 'new_memories' END AS reason FROM s GROUP BY user_id"))
def retrain_trigger(spark, sf):
    memories = ruled(spark, sf).groupBy("user_id").agg(F.count_if(F.col("severity") == "critical").alias("memories"))
    return memories.select("user_id", memory.should_retrain(F.col("user_id") % 17 == 0, F.col("user_id") % 11 == 0, F.col("memories"), 30).alias("reason"))


@query("q_K19_replay_tables", v.with_views(f"WITH {_templates_sql()}, t AS (SELECT trade_qty, action FROM v_bars, tpl WHERE scenario IN ('quote_stuffing', 'momentum_ignition', 'twap_execution')) SELECT * FROM (SELECT 'orders' AS name, count(*) AS n FROM t UNION ALL SELECT 'trades', count(*) FILTER (trade_qty > 0) FROM t UNION ALL SELECT 'alerts', count(*) FILTER (action <> 'allow') FROM t UNION ALL SELECT 'traces', count(*) FROM t)"))
def replay_tables(spark, sf):
    """Three replays persisted in their child tables, and an unfinished one that does not count."""
    root, bars = new_folder(spark), v.bars(spark, sf)
    for scenario in ("quote_stuffing", "momentum_ignition", "twap_execution"):
        tables.persist_run(replay.run_tables(replay.ticks(bars, scenario, ["ts_ms", "tie"])), root, scenario)
    for name, rows in replay.run_tables(replay.ticks(bars, "spoofing_layering", ["ts_ms", "tie"])).items():
        rows.withColumn("run_id", F.lit("unfinished")).write.parquet(f"{root}/{name}/run=unfinished")
    counts = [tables.read_run_table(spark, root, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name in ("orders", "trades", "alerts", "traces")]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("q_K22_job_log", v.with_views("SELECT user_id AS job, arg_max(event_type, (ts_ms, event_id)) AS status, max(ts_ms) - min(ts_ms) AS took_ms, count(*) AS n FROM ev GROUP BY user_id"))
def job_log(spark, sf):
    return tables.job_status(v.events(spark, sf).select(F.col("user_id").alias("job"), F.col("event_type").alias("status"), F.col("ts_ms").alias("at_ms"), F.col("event_id").alias("nth")))


@query("q_V08_filters", "SELECT p_partkey, p_name FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND (contains(lower(p_name), 'e') AND contains(lower(p_name), 're') OR contains(lower(p_type), 're'))")
def filters(spark, sf):
    return tables.filtered(table(spark, sf, "part"), {"p_brand": ["Brand#11", "Brand#12", "Brand#13"]}, "RE", ["p_name", "p_type"]).select("p_partkey", "p_name")


@query("q_V18_case_details", v.with_views(f"WITH {_RULED_SQL}, e AS (SELECT event_id, list_sort([struct_pack(o := -abs(burst), k := 'burst'), struct_pack(o := -abs(cancel_rate), k := 'cancel_rate'), struct_pack(o := -abs(drift), k := 'drift')]) AS l FROM s), w AS (SELECT user_id, list(event_id ORDER BY ts_ms, event_id)[:5] AS first FROM s WHERE action <> 'allow' GROUP BY user_id) SELECT s.event_id, array_to_string(list_transform(e.l, lambda x: x.k), ',') AS features, array_to_string(w.first, ',') AS timeline FROM s JOIN e USING (event_id) JOIN w USING (user_id) WHERE s.action = 'block'"))
def case_details(spark, sf):
    """A case's features by size, and the first five alerts of its agent."""
    rows = ruled(spark, sf)
    named = F.create_map(*[x for c in ("burst", "cancel_rate", "drift") for x in (F.lit(c), F.col(c))])
    ranks = rows.filter("action <> 'allow'").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts_ms", "event_id")))
    firsts = ranks.filter("r <= 5").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("timeline"))
    cases = rows.filter("action = 'block'").withColumn("m", named)
    return cases.join(firsts.hint("merge"), "user_id").select("event_id", F.array_join(F.transform(tables.top_entries("m", 3), lambda e: e["key"]), ",").alias("features"), "timeline")


@query("q_V21_promotion_metrics", v.with_views("SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN p END AS brier, CASE WHEN doc_id % 4 <> 0 THEN markout END AS lift FROM v_scores"))
def promotion_metrics(spark, sf):
    """Metrics out of a report; all are null where one is missing."""
    report = F.to_json(F.struct(F.col("p").alias("brier"), F.when(F.col("doc_id") % 4 != 0, F.col("markout")).alias("lift"), F.lit("x").alias("other")))
    parsed = v.scores(spark, sf).select("doc_id", F.from_json(report, "brier double, lift double").alias("m"))
    complete = F.col("m.brier").isNotNull() & F.col("m.lift").isNotNull()
    return parsed.select("doc_id", F.when(complete, F.col("m.brier")).alias("brier"), F.when(complete, F.col("m.lift")).alias("lift"))


@query("q_V31_json_safe", v.with_views("SELECT event_id, CASE WHEN event_id % 5 IN (1, 2) THEN NULL ELSE value END AS value FROM ev"))
def json_safe(spark, sf):
    """Numbers that JSON lacks become null on the way through it."""
    x = F.when(F.col("event_id") % 5 == 1, F.lit(float("nan"))).when(F.col("event_id") % 5 == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    rows = v.events(spark, sf).withColumn("x", x).select(F.to_json(F.struct("event_id", scoring.safe_number("x").alias("value"))).alias("j"))
    return rows.select(F.from_json("j", "event_id bigint, value double").alias("r")).select("r.*")


@query("q_V25_rebuilt_training_rows", v.with_views("""SELECT f.coin, count(*) AS n, round(avg((b.bid_px + b.ask_px) / 2), 6) AS avg_mid, round(avg(c.funding), 9) AS avg_funding FROM v_fills f ASOF JOIN v_book b ON f.coin = b.coin AND f.ts_ms >= b.ts_ms ASOF LEFT JOIN v_ctx c ON f.coin = c.coin AND f.ts_ms >= c.ts_ms GROUP BY f.coin"""))
def rebuilt_training_rows(spark, sf):
    """Fills, books and contexts from the lake joined again into gold rows, written, and read."""
    root = new_folder(spark)
    keyed = lambda df: df.withColumn("coin", F.col("coin").cast("string"))
    for name, rows in (("fills", v.fills(spark, sf)), ("l2_book", v.book(spark, sf, v.IN_TIME)), ("asset_ctxs", v.contexts(spark, sf, v.IN_TIME))):
        lake.write_table(keyed(rows), root, name)
    fills, book, contexts = (lake.read_table(spark, root, n).drop("date").withColumn("coin", F.col("coin").cast("string")) for n in ("fills", "l2_book", "asset_ctxs"))
    rows = temporal.asof_backward(temporal.asof_backward(fills, book, "coin", "l2_"), contexts, "coin", "asset_", how="left")
    lake.write_table(rows, root, "training_rows")
    gold = lake.read_table(spark, root, "training_rows")
    return gold.groupBy(F.col("coin").cast("long").alias("coin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(market.mid("l2_bid_px", "l2_ask_px")), 6).alias("avg_mid"), F.round(F.avg("asset_funding"), 9).alias("avg_funding"))


@query("q_V26_replay_window", v.with_views("SELECT tie, coin::bigint AS coin, ts_ms FROM v_bars WHERE strftime(make_timestamp(ts_ms * 1000), '%Y%m%d') BETWEEN '20240110' AND '20240112'"))
def replay_window(spark, sf):
    """The days of a window, out of the lake's partitions."""
    path = lake.write_table(v.bars(spark, sf).withColumn("coin", F.col("coin").cast("string")), new_folder(spark), "candles")
    return spark.read.parquet(path).filter(F.col("date").cast("string").between("20240110", "20240112")).select("tie", F.col("coin").cast("long").alias("coin"), "ts_ms")


@query("q_V32_metric_gates", v.with_views("WITH m AS (SELECT scenario, avg((p - y::int) ** 2) AS brier, count(*) AS n FROM v_scores GROUP BY scenario) SELECT scenario, CASE WHEN brier > 0.4 AND n < 100 THEN 'brier,n' WHEN brier > 0.4 THEN 'brier' WHEN n < 100 THEN 'n' ELSE '' END AS failed FROM m"))
def metric_gates(spark, sf):
    """Which of a phase's gates each run fails."""
    runs = v.scores(spark, sf).groupBy("scenario").agg(stats.brier().alias("brier"), F.count(F.lit(1)).alias("n"))
    gates = {"brier": F.col("brier") <= 0.4, "n": F.col("n") >= 100}
    return runs.select("scenario", F.array_join(F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in gates.items()])), ",").alias("failed"))


def _turns(spark, sf):
    """Conversations as event sequences: the role as mark, a second a turn, the text's size as feature; assistant turns stand for unsafe ones."""
    from tidelake.operators import point_process

    rows = table(spark, sf, "conversations").withColumns({"ts": F.col("turn").cast("long") * 1000, "size": F.coalesce(F.length("text"), F.lit(0)) / 1000})
    mark = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    return point_process.sequences(rows, "conv_id", ["turn"], "ts", mark, ["size"], F.coalesce(F.col("role") == "assistant", F.lit(False)))


@query("q_M07_gated_scores")
def gated_scores(spark, sf):
    """Every turn's probability by a gated net trained on all conversations; tests/test_point_process.py checks gradients and scores."""
    from tidelake.operators import point_process

    seqs, model = _turns(spark, sf), point_process.Gated(3, 1)
    params, _ = point_process.fit(seqs, model, steps=6, rate=0.05)
    return point_process.scores(seqs, "conv_id", model, params)


@query("q_M08_continuous_scores")
def continuous_scores(spark, sf):
    """As q_M07_gated_scores, by the model in continuous time."""
    from tidelake.operators import point_process

    seqs, model = _turns(spark, sf), point_process.Continuous(3, 1)
    params, _ = point_process.fit(seqs, model, steps=4, rate=0.05)
    return point_process.scores(seqs, "conv_id", model, params)


@query("q_M01_out_of_fold")
def out_of_fold(spark, sf):
    """Boosted trees out of fold with calibration on each fold's latest fifth; the fits are drawn, so tests hold them to what must be true of them."""
    from tidelake.operators import models

    rows = v.scores(spark, sf).withColumns({"id": F.col("doc_id"), "size": F.col("p") * 997})
    return models.out_of_fold(rows, ["size", "markout"], "y", 2, 5000, 5000, trees=5).select("doc_id", "fold", "raw", "p")
