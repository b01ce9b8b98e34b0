"""Queries of the payables operators, with their SQL."""

from __future__ import annotations

from .plans import agg_plans, bundle_plans, credit_profile_plans, dictionary_plans, extraction_plans, hint_plans, join_plans, layout_plans, learning_plans, number_plans, profile_plans, rows_plans, rule_plans, settlement_plans, store_plans, strategy_plans  # noqa: F401
from .plans.book import ORACLES, QUERIES

FLAGSHIP = "grp_engine"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
