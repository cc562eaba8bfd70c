"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from kinmatch.plans import linkage_queries, linkage_sql, skew_queries

QUERIES = {**linkage_queries.QUERIES, **skew_queries.QUERIES}
SQL = {**linkage_sql.SQL, **skew_queries.SQL}
