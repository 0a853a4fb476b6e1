"""All registered queries."""

from repolith.plans import content_queries, history_queries, source_queries, state_queries, structure_queries  # noqa: F401
from repolith.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
