"""All queries of the core; importing the modules registers them."""

from __future__ import annotations

from lectern.plans import catalog_queries, process_queries, search_queries, text_queries, timestamp_queries  # noqa: F401
from lectern.plans.core_queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
