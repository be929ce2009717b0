"""All queries of the library and their SQL counterparts, by name."""

from __future__ import annotations

from . import daily, graph, hive, importing, jobs, retrieval, scans  # noqa: F401  they register themselves
from .catalog import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
