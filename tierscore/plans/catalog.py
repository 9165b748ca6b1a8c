"""All registered queries."""

from tierscore.plans import lookup_queries, request_queries, scoring, source_queries, stats_queries  # noqa: F401
from tierscore.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
