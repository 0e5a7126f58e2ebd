"""Registered queries over the driver tables."""

from altloom.plans import (  # noqa: F401
    aggregate_queries, classify_queries, describe_queries, join_queries, ordered_queries, source_queries,
    stream_queries, text_queries,
)
from altloom.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
