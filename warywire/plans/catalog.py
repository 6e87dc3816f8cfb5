"""Loads every module that registers queries."""

from . import (  # noqa: F401
    evaluation_queries, extractor_queries, feature_queries, graph_queries, model_queries,
    search_queries, source_queries, stream_queries, vector_queries,
)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
