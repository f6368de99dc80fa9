"""All checked queries."""

from certloom.plans import ingest_queries, search_queries, stats_queries, stream_queries  # noqa: F401
from certloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
