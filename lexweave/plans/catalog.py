"""All registered queries of the core and their oracle SQL."""

from __future__ import annotations

from lexweave.plans import citation_graph, data_quality, ranking_queries, structuring, summary_queries
from lexweave.plans.citation_graph import most_cited

__all__ = ["ORACLE", "QUERIES", "most_cited"]
QUERIES = data_quality.QUERIES | citation_graph.QUERIES | structuring.QUERIES | ranking_queries.QUERIES | summary_queries.QUERIES
ORACLE = data_quality.ORACLE | citation_graph.ORACLE | structuring.ORACLE | ranking_queries.ORACLE | summary_queries.ORACLE
