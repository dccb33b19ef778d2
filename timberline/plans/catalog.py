"""All registered queries."""

from __future__ import annotations

from timberline.plans import count_queries, filter_queries, ingest_queries, run_queries  # noqa: F401
from timberline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
