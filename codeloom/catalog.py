"""All registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from codeloom.plans import addition_queries, graph_queries, more_queries, planning_queries, source_queries, tool_queries  # noqa: F401  they register
from codeloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
