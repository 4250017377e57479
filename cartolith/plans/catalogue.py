"""All queries of the core library by name, with the same in SQL where SQL can express them."""

from __future__ import annotations

from . import clone_queries, event_queries, graph_queries, history_queries, join_queries, metric_queries, misc_queries, module_queries, parser_queries, report_queries, search_queries, stream_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "clone_islands"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
