"""Plans: derived tables and the registry of queries."""

from postlake.plans import flow_queries, scalar_queries, search_queries, source_queries, stream_queries, table_queries  # noqa: F401
from postlake.plans.registry import QUERIES

__all__ = ["QUERIES"]
