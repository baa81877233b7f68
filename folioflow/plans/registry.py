"""All registered queries outside ``llm``: name to callable, and name to SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.plans import graph_queries, report_queries, search_queries, table_queries, tool_queries, writing_queries

_PARTS = (search_queries, table_queries, graph_queries, writing_queries, report_queries, tool_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL: dict[str, str] = {k: v for p in _PARTS for k, v in p.SQL.items()}
FLAGSHIP = "e9_keyword_search"
