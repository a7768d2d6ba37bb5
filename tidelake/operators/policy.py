"""Decisions from features and scores: the rule engine, severities, cases, actions, promotion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules by name, in the order in which they are reported. A missing feature reads as 0,
# a missing shortest interarrival as 1000.
RULES = (
    ("burst_rate_high", "burst > 15"),
    ("large_layered_quantity", "quantity_sum > 3"),
    ("one_sided_sell_pressure", "sell_ratio > 0.9"),
    ("rapid_order_interarrival", "min_interarrival < 10"),
    ("sharp_buy_price_drift", "drift > 50"),
    ("cancel_rate_spike", "cancel_rate > 0.45"),
    ("wash_trade_self_cross_proxy", "self_cross >= 3"),
    ("cross_account_synchronized_burst", "agents >= 2 AND burst > 10"),
    ("stop_run_or_feedback_sweep", "price_range > 75 AND quantity_max > 0.05"),
)
FEATURES = ("burst", "quantity_sum", "sell_ratio", "min_interarrival", "drift", "cancel_rate", "self_cross", "agents", "price_range", "quantity_max")
# Risk score of each action.
RISK_SCORES = {"allow": 0.15, "alert": 0.58, "block": 0.88}
# Which action outranks which.
PRIORITIES = {"block_simulated_agent": 5, "critical_alert": 4, "request_human_review": 4, "warning_alert": 3, "monitor": 2, "add_to_benchmark": 2, "request_retraining": 2, "no_action": 1}

# The next step for each severity, and why each action is taken.
NEXT_STEPS = {
    "critical": "Halt simulated agent connection; cancel resting orders; open formal investigation in the compliance queue.",
    "high": "Raise alert severity and route to active compliance review.",
    "medium": "Monitor for sustained behavior; collect 5-minute evidence window.",
    "low": "No action; log observation only.",
}
RATIONALES = {
    "block_simulated_agent": "Critical severity + high model confidence; halt agent and request review.",
    "critical_alert": "High severity with matched rules; raise priority and review.",
    "warning_alert": "Medium severity; emit warning and continue monitoring.",
    "monitor": "Low model confidence; collect more evidence before acting.",
    "no_action": "Within normal envelope; log only.",
}
# How strongly an evading mutation changes a feature at each difficulty.
EVASION_SCALES = {"easy": 0.30, "medium": 0.55, "hard": 0.85}


def matched_rules() -> Column:
    """Names of the rules that the feature columns match."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.expr(predicate), F.lit(False)), F.lit(name)) for name, predicate in RULES]))


def rule_action(rules: str = "matched_rules") -> Column:
    return F.when(F.size(rules) >= 2, "block").when(F.size(rules) == 1, "alert").otherwise("allow")


def by_name(column: str | Column, values: dict) -> Column:
    """A lookup of fixed values."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col(column) if isinstance(column, str) else column]


def probability_label(p: Column, alert: float = 0.40, block: float = 0.75) -> Column:
    return F.when(p >= block, "BLOCK").when(p >= alert, "ALERT").otherwise("ALLOW")


def tick_severity(action: str = "action", score: str = "risk_score") -> Column:
    return F.when(F.col(action) == "block", "critical").when(F.col(action) == "alert", "high").when(F.col(score) >= 0.45, "medium").otherwise("low")


def fill_severity(action: str = "action", score: str = "calibrated") -> Column:
    withheld = F.col(action) == "withhold_quote"
    return F.when(withheld & (F.col(score) >= 0.75), "critical").when(withheld, "high").when(F.col(score) >= 0.45, "medium").otherwise("low")


def case_confidence(score: str) -> Column:
    return F.least(F.lit(0.99), 0.4 + 0.6 * F.col(score))


def case_action(severity: str = "severity", confidence: str = "confidence") -> Column:
    s = F.col(severity)
    return F.when(s == "critical", "block_simulated_agent").when(s == "high", "critical_alert").when(s == "medium", "warning_alert").when(F.col(confidence) < 0.3, "monitor").otherwise("no_action")


# What each behaviour is called.
BEHAVIOURS = {
    "markout": "Adverse-selection markout risk", "spoofing_layering": "Spoofing / layering", "quote_stuffing": "Quote stuffing", "momentum_ignition": "Momentum ignition",
    "bursty": "Bursty unsafe agent behavior (unclassified)", "high_cancel_rate": "High cancel-rate behavior", "generic": "Generic anomalous flow",
}
#: The rule that scored fills match; it is not one of the engine's.
MARKOUT_RULE = "promoted_markout_threshold"


def behaviour(rules: str = "matched_rules") -> Column:
    """The behaviour that a set of matched rules points to."""
    has = lambda *names: F.forall(F.array(*map(F.lit, names)), lambda x: F.array_contains(rules, x))
    return by_name(
        F.when(has(MARKOUT_RULE), "markout")
        .when(has("one_sided_sell_pressure", "cancel_rate_spike"), "spoofing_layering")
        .when(has("rapid_order_interarrival", "cancel_rate_spike"), "quote_stuffing")
        .when(F.arrays_overlap(rules, F.array(F.lit("sharp_buy_price_drift"), F.lit("stop_run_or_feedback_sweep"))), "momentum_ignition")
        .when(F.col("burst") > 12, "bursty").when(F.col("cancel_rate") > 0.5, "high_cancel_rate").otherwise("generic"), BEHAVIOURS
    )


# The control recommended for each action.
CONTROLS = {"block": "Halt connection for agent-id. Cancel all matching floating orders.", "alert": "Raise alert severity and route to active compliance queue.", "allow": "None required"}


def observation() -> Column:
    """What was seen, in words, from the rules' features."""
    return F.format_string("Observed interarrival %.1fms, burst %.1f/s, cancel-rate %.2f, sell-ratio %.2f.", "min_interarrival", "burst", "cancel_rate", "sell_ratio")


def drift_severity(psi: Column) -> Column:
    return F.when(psi >= 0.25, "significant").when(psi >= 0.10, "moderate").otherwise("none")


def promotion_verdict(champion: str, challenger: str, lift: float = 0.0, tolerance: float = 0.0, latency_ms: float = 1.0, least: int = 4) -> tuple[Column, Column]:
    """(criteria passed, verdict) of one struct of metrics against another. An unverified model is always rejected."""
    a, b = F.col(champion), F.col(challenger)
    criteria = [b["markout_lift"] - a["markout_lift"] >= lift, b["pr_auc"] >= a["pr_auc"] - tolerance, b["brier"] <= a["brier"], b["latency_ms"] <= latency_ms, b["leakage_safe"]]
    passed = sum((c.cast("int") for c in criteria[1:]), criteria[0].cast("int"))
    return passed, F.when(~b["leakage_safe"], "reject").when(passed >= least, "promote").when(passed >= least - 1, "needs_more_data").otherwise("reject")


def best_overlap_novelty(rules: str, name: str, seen_rules: str, seen_name: str) -> Column:
    """1 minus the likeness of a case to one memory: the rules' Jaccard similarity, 0.6 at least for the same name."""
    union = F.size(F.array_union(rules, seen_rules))
    jaccard = F.when((F.size(rules) > 0) & (F.size(seen_rules) > 0), F.size(F.array_intersect(rules, seen_rules)) / union).otherwise(0.0)
    return F.greatest(F.lit(0.0), 1 - F.greatest(jaccard, F.when(F.col(name) == F.col(seen_name), 0.6).otherwise(0.0)))


def _known(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def _no_worse(candidate: Column, incumbent: Column, least_gain: float) -> Column:
    """A missing metric fails, an undefined one passes."""
    return F.when(candidate.isNull() | incumbent.isNull(), False).when(F.isnan(candidate) | F.isnan(incumbent), True).otherwise(candidate - incumbent >= least_gain)


def judge_votes(candidate: str, incumbent: str, auc_loss: float = 0.005, f1_loss: float = 0.01, holdout_gain: float = 0.01, latency_inflation: float = 0.30, gap_growth: float = 0.05) -> Column:
    """How many of five votes a candidate's metrics (pr_auc, f1, holdout, p99_ms) win against an incumbent's."""
    c, i = F.col(candidate), F.col(incumbent)
    latency = F.when(c["p99_ms"].isNull() | i["p99_ms"].isNull() | (i["p99_ms"] <= 0), True).otherwise(F.try_divide(c["p99_ms"], i["p99_ms"]) <= 1 + latency_inflation)
    gaps_known = _known(c["pr_auc"]) & _known(c["holdout"]) & _known(i["pr_auc"]) & _known(i["holdout"])
    overfit = F.when(gaps_known, c["pr_auc"] - c["holdout"] <= i["pr_auc"] - i["holdout"] + gap_growth).otherwise(True)
    votes = [_no_worse(c["pr_auc"], i["pr_auc"], -auc_loss), _no_worse(c["f1"], i["f1"], -f1_loss), _no_worse(c["holdout"], i["holdout"], holdout_gain), latency, overfit]
    return sum((v.cast("int") for v in votes[1:]), votes[0].cast("int"))


def judge_verdict(votes: Column, *baseline_lifts: Column) -> Column:
    """Three votes promote, one or two ask for more data; a reported lift over a baseline below zero always rejects."""
    loses = F.lit(False)
    for lift in baseline_lifts:
        loses = loses | F.coalesce(F.isnan(lift) | (lift < 0), F.lit(False))
    return F.when(loses, "reject").when(votes >= 3, "promote").when(votes >= 1, "needs_more_data").otherwise("reject")


def evaded(difficulty: str = "difficulty") -> dict[str, Column]:
    """Each feature that a mutation may change, made harder to detect; an unknown difficulty counts as medium."""
    scale = F.coalesce(by_name(difficulty, EVASION_SCALES), F.lit(EVASION_SCALES["medium"]))
    less = lambda name, share, floor: F.greatest(F.lit(floor), F.col(name) * (1 - share * scale))
    return {"min_interarrival": F.col("min_interarrival") + 200 * scale, "burst": less("burst", 0.6, 0.5), "quantity_max": less("quantity_max", 0.5, 0.001), "drift": less("drift", 0.4, 0.0), "cancel_rate": less("cancel_rate", 0.55, 0.02)}


def market_regime(spread_bps: Column, risk_score: Column) -> Column:
    return F.when(spread_bps >= 4, "thin liquidity").when(risk_score >= 0.75, "volatile").otherwise("calm")
