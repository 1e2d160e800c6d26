"""The queries of this subpackage, registered on import."""

from fixtrace.llm import corpus_queries, queries  # noqa: F401
from fixtrace.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
