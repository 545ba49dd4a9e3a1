"""Registered queries: operators bound to the driver's tables, each with its SQL for the oracle."""

from __future__ import annotations

from . import ingest, knowledge, lifecycle, records, report, search, state, structure

_MODULES = (ingest, search, knowledge, lifecycle, report, records, state, structure)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
