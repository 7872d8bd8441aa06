"""All queries of the library's own operators, with their SQL for DuckDB."""

from __future__ import annotations

from lexspark.queries import data, graph, library, metrics, retrieval, text
from lexspark.queries.registry import ORACLE, QUERIES

__all__ = ["MODULES", "ORACLE", "QUERIES"]

MODULES = (data, graph, library, metrics, retrieval, text)
