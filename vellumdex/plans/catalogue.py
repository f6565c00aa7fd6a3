"""All queries of the library outside the training-text package, and their SQL."""

from __future__ import annotations

from vellumdex.plans import engine_queries, incremental_queries, retrieval_queries

QUERIES = {**retrieval_queries.QUERIES, **incremental_queries.QUERIES, **engine_queries.QUERIES}
ORACLES = {**retrieval_queries.ORACLES, **incremental_queries.ORACLES, **engine_queries.ORACLES}
