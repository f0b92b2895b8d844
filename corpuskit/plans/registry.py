"""All queries over the driver's tables, by name, with their SQL."""

from __future__ import annotations

from corpuskit.plans import folder_queries, graph_queries, table_queries, text_queries, whole_queries

QUERIES = {**text_queries.QUERIES, **table_queries.QUERIES, **graph_queries.QUERIES, **folder_queries.QUERIES, **whole_queries.QUERIES}
ORACLES = {**text_queries.ORACLES, **table_queries.ORACLES, **graph_queries.ORACLES, **folder_queries.ORACLES, **whole_queries.ORACLES}
