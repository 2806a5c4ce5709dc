"""Runnable queries over the given tables."""

from riskloom.catalog import feature_queries, model_queries, monitor_queries, profile_queries, whole_queries  # noqa: F401
from riskloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
