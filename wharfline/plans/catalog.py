"""All queries of the library, by name, with the SQL they must agree with."""

from __future__ import annotations

from . import documents, forecast, gates, ingestion, ledger, lifecycle, retrieval, serving, survival, worklist
from .registry import Query

MODULES = (worklist, survival, lifecycle, forecast, gates, retrieval, ingestion, documents, ledger, serving)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.registry.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.registry.sql.items()}
