"""Queries over the driver tables. Importing this package registers them."""

from tidelake.plans import artifact_queries, contract_queries, decision_queries, detail_queries, lake_queries, model_queries, policy_queries, serving_queries, source_queries, stats_queries, temporal_queries
from tidelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "artifact_queries", "contract_queries", "decision_queries", "detail_queries", "lake_queries", "model_queries", "policy_queries", "serving_queries", "source_queries", "stats_queries", "temporal_queries"]
