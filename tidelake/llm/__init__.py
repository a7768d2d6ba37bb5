"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from tidelake.llm import (
    bpe_codec,
    exact_dedup,
    html_extraction,
    language_id,
    minhash_dedup,
    packing,
    periodic_runs,
    permutation_index,
    quality_resampling,
    secret_scan,
    substring_dedup,
    suffix_dedup,
    token_alignment,
)

_MODULES = (
    bpe_codec,
    exact_dedup,
    html_extraction,
    language_id,
    minhash_dedup,
    packing,
    periodic_runs,
    permutation_index,
    quality_resampling,
    secret_scan,
    substring_dedup,
    suffix_dedup,
    token_alignment,
)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
