"""Registered queries: each plan next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function name; ``sql`` is its DuckDB counterpart."""
    def register(plan: Plan) -> Plan:
        key = name or plan.__name__
        QUERIES[key] = plan
        if sql:
            ORACLE_SQL[key] = sql
        return plan

    return register


def load_all() -> None:
    from . import dashboards, event_tables, joins, models, rollups, streams, table_jobs  # noqa: F401
