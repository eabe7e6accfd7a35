"""All registered queries and, where SQL can express them, the equivalent SQL."""

from __future__ import annotations

from relata import block_queries, conditional_queries, queries  # noqa: F401 - the others add their queries to those of the last

QUERIES = dict(queries.QUERIES)
ORACLE_SQL = dict(queries.ORACLE_SQL)
