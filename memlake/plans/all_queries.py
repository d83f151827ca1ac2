"""Imports every module of queries, so that the registry is whole."""

from memlake.plans import chat_queries, cycle_queries, more_queries, retrieval_queries, stream_queries, text_queries  # noqa: F401
from memlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
