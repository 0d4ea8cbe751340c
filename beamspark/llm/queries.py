"""Thin queries of the operators in this folder, each over its whole table."""

from __future__ import annotations

from beamspark.llm import op_queries  # noqa: F401 - registers the queries
from beamspark.llm.shared import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
