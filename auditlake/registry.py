"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from .plans import audit, detection, evaluation, files, scores, statistics, views

_PLANS = (audit, evaluation, detection, statistics, views, files, scores)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
