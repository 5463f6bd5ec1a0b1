"""Registry of the checkable queries: a Spark plan and, where one exists, the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query registered twice: {name}")
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return add


def load() -> None:
    """Import every module that registers queries."""
    from caderneta.plans import (  # noqa: F401
        queries_cascade,
        queries_fields,
        queries_ingest,
        queries_jobs,
        queries_model,
        queries_ordered,
        queries_recon,
        queries_similarity,
        queries_statement,
        queries_text,
    )
