"""Every registered query of the analytics operators: the operator on the driver tables, and its oracle SQL."""

from __future__ import annotations

from tidemark.plans import batch_queries, market_queries, mechanism_queries, record_queries, rule_queries, tail_queries, workflow_queries

_MODULES = (market_queries, tail_queries, record_queries, workflow_queries, rule_queries, batch_queries, mechanism_queries)


def queries() -> dict:
    return {k: f for m in _MODULES for k, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: sql for m in _MODULES for k, (_, sql) in m.QUERIES.items() if sql}
