"""All queries of the core, with their SQL for DuckDB."""

from __future__ import annotations

from loomgraph.plans import activity, pipeline, records, retrieval, roundtrips

FLAGSHIP = "unified_search"
QUERIES = records.QUERIES | retrieval.QUERIES | activity.QUERIES | pipeline.QUERIES | roundtrips.QUERIES
SQL = records.SQL | retrieval.SQL | activity.SQL | pipeline.SQL | roundtrips.SQL
