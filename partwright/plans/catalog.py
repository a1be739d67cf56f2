"""All named queries of the core with their SQL."""

from __future__ import annotations

from partwright.plans import catalogue, matching, preparation, profiling, records, relational

_MODULES = (preparation, profiling, catalogue, matching, records, relational)


def queries() -> dict:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
