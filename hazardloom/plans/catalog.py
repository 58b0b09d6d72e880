"""All registered queries: name -> (callable, SQL twin or None)."""

from __future__ import annotations

from hazardloom.plans import model_queries, prep_queries, source_queries, stats_queries

CATALOG = {**stats_queries.QUERIES, **prep_queries.QUERIES, **model_queries.QUERIES, **source_queries.QUERIES}
