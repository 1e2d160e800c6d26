"""All checked queries; importing the modules registers them."""

from fixtrace.plans import (  # noqa: F401
    metric_queries,
    preparation_queries,
    retrieval_queries,
    text_queries,
    verdict_queries,
)
from fixtrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
