"""All registered queries of the graph and of its sources: importing a module of queries registers them."""

from __future__ import annotations

from . import embedding_queries, graph_queries, parse_queries, source_queries, store_queries  # noqa: F401
from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
