"""All queries and all SQL of the engine's own operators."""

from __future__ import annotations

from lexiforge.plans import compare_queries, compare_sql, findings_queries, findings_sql, hypothesis_queries, hypothesis_sql, language_queries, language_sql, oracles, queries, report_queries, report_sql

QUERIES = queries.QUERIES | language_queries.QUERIES | findings_queries.QUERIES | hypothesis_queries.QUERIES | compare_queries.QUERIES | report_queries.QUERIES
ORACLE_SQL = oracles.ORACLE_SQL | language_sql.ORACLE_SQL | findings_sql.ORACLE_SQL | hypothesis_sql.ORACLE_SQL | compare_sql.ORACLE_SQL | report_sql.ORACLE_SQL
