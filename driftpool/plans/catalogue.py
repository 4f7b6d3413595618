"""All registered queries."""

from driftpool.plans import analysis_queries, protocol_queries, selection_queries  # noqa: F401
from driftpool.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
