"""All registered queries and their expected results."""

from __future__ import annotations

from pluvia.plans import (
    oracle_forecast, oracle_models, oracle_panel, oracle_profile, oracle_structure, oracle_uncertainty,
    queries_forecast, queries_models, queries_panel, queries_profile, queries_structure, queries_uncertainty,
)

_QUERIES = (queries_panel, queries_profile, queries_forecast, queries_structure, queries_uncertainty, queries_models)
_ORACLES = (oracle_panel, oracle_profile, oracle_forecast, oracle_structure, oracle_uncertainty, oracle_models)


def registered() -> dict:
    return {name: plan for module in _QUERIES for name, plan in module.Q.items()}


def expected_sql() -> dict[str, str]:
    return {name: sql for module in _ORACLES for name, sql in module.S.items()}
