"""All registered queries and their SQL."""

from __future__ import annotations

from halyard.plans import archive_queries, cluster_queries, io_queries, job_queries, node_queries, rule_queries, series_queries  # noqa: F401
from halyard.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
