"""Query catalogue: each query beside its equivalent SQL."""

from . import evidence_queries, knowledge_queries, text_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "evidence_queries", "knowledge_queries", "text_queries"]
