"""All registered queries of the core and their SQL counterparts."""

from __future__ import annotations

from wordloom.plans import comparisons, comparisons_sql, oracle, queries, results

QUERIES = queries.QUERIES | comparisons.QUERIES | results.QUERIES
ORACLE = oracle.ORACLE | comparisons_sql.ORACLE | results.SQL
