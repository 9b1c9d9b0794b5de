"""All queries and their SQL forms."""

from __future__ import annotations

from . import fold_queries, graph_memory, graph_queries, live_queries, memory_queries, report_queries, text_queries, upkeep_queries, vector_queries  # noqa: F401  enter their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
