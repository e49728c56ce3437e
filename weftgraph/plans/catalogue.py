"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from . import extract_queries, graph_queries, project_queries, search_queries, source_queries, table_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
