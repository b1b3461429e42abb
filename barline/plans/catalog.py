"""Imports every query module so that the registry is complete."""

from barline.plans import (  # noqa: F401
    aggregate_queries,
    evaluation_queries,
    feature_queries,
    filter_queries,
    indicator_queries,
    join_queries,
    missing_queries,
    source_queries,
    streaming_queries,
)
from barline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
