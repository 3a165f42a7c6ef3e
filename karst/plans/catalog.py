"""The query catalogue over the driver's tables, and the SQL that must agree with it."""

from __future__ import annotations

from karst.plans import eval_queries, graph_queries, search_queries, store_queries, text_queries

PARTS = (graph_queries, search_queries, text_queries, eval_queries, store_queries)
QUERIES: dict = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL: dict = {k: v for p in PARTS for k, v in p.ORACLE_SQL.items()}
