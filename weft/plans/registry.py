"""All queries of the core by name, and the SQL that must agree with them."""

from __future__ import annotations

from weft.plans import index, pipeline, q_capture, q_graph, q_history, q_retrieval, q_text  # noqa: F401
from weft.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
