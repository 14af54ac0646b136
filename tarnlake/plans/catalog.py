"""Registered queries over the test tables and the SQL each must equal."""

from __future__ import annotations

from tarnlake.plans import case_plans, coverage_plans, entity_plans, extract_plans, ladder_plans, page_plans, ranking_plans, serving_plans

_PARTS = (ranking_plans, entity_plans, page_plans, ladder_plans, extract_plans, serving_plans, coverage_plans, case_plans)
QUERIES: dict = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLES: dict = {k: s for part in _PARTS for k, s in part.ORACLES.items()}
