"""All registered queries of the library and their SQL for an independent engine."""

from __future__ import annotations

from tabweft.plans import fidelity_queries, tabular_queries

_MODULES = (fidelity_queries, tabular_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
