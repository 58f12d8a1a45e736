"""All queries over the synthetic tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import brief_queries, evidence_queries, flow_queries, graph_queries, integrity_queries, meta_queries, ranking_queries, record_queries, screening_queries, source_queries, summary_queries, text_queries  # noqa: F401  they register
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "discovery_flow"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
