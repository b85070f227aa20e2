"""All registered queries."""

from passagework.plans import (  # noqa: F401
    answer_queries,
    knowledge_queries,
    ops_queries,
    row_queries,
    text_queries,
    vector_queries,
)
from passagework.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
