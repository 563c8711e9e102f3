"""All registered queries: importing the modules fills the registry."""

from . import dialogue_queries, evaluation_queries, flow_queries, judged_queries, memory_queries, retrieval_queries, rubric_queries, session_queries, storage_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
