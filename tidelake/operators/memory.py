"""Memories of cases: which of a stream of cases are new, given those before them; when to train again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cases at least so new are remembered.
NOVELTY_THRESHOLD = 0.35


def remembered(cases: DataFrame, order: str, threshold: float = NOVELTY_THRESHOLD) -> DataFrame:
    """``novel`` of each case (rules, name) against the memories that cases before it left, in one pass over signatures.

    A case that repeats a signature with rules is never new, whether the first one was remembered or not; one without
    rules always is, as only its name can match. So what is decided one after the other are the distinct signatures,
    of which there are at most names times sets of rules, at their first case.
    """
    firsts = cases.groupBy("rules", "name").agg(F.min(order).alias("first"))
    ordered = firsts.agg(F.array_sort(F.collect_list(F.struct("first", "rules", "name"))).alias("all"))

    def novelty(case: Column, seen: Column) -> Column:
        both, any_ = F.size(F.array_intersect(case["rules"], seen["rules"])), F.size(F.array_union(case["rules"], seen["rules"]))
        overlap = F.when((F.size(case["rules"]) > 0) & (F.size(seen["rules"]) > 0), both / any_).otherwise(0.0)
        return F.greatest(F.lit(0.0), 1 - F.greatest(overlap, F.when(case["name"] == seen["name"], 0.6).otherwise(0.0)))

    empty = F.slice("all", 1, 0)
    step = lambda shelf, case: F.when(F.forall(shelf, lambda m: novelty(case, m) >= threshold), F.concat(shelf, F.array(case))).otherwise(shelf)
    shelf = ordered.select(F.explode(F.aggregate("all", empty, step)).alias("m")).select("m.first", F.lit(True).alias("opened"))
    found = firsts.join(shelf.hint("merge"), "first", "left").select(F.col("rules").alias("_r"), F.col("name").alias("_n"), "first", "opened")
    rows = cases.join(found.hint("merge"), (F.col("rules") == F.col("_r")) & (F.col("name") == F.col("_n")))
    new = (F.size("rules") == 0) | ((F.col(order) == F.col("first")) & F.coalesce("opened", F.lit(False)))
    return rows.withColumn("novel", new).drop("_r", "_n", "first", "opened")


def should_retrain(force: Column, pending: Column, memories: Column, least: int = 1) -> Column:
    """Why to train: forced, data asked for before, or enough new memories; null where there is no reason."""
    return F.when(force, "forced").when(pending, "pending").when(memories >= least, "new_memories")
