"""SQL that gives the same result, where SQL can express the operator."""

from __future__ import annotations

SQL: dict[str, str] = {
    "p2_found": """
        WITH best AS (
            SELECT s1_idx, pool_idx, MAX(bscore) AS bscore FROM candidates
            WHERE bscore IS NOT NULL AND NOT isnan(bscore) AND s1_idx IS NOT NULL AND pool_idx IS NOT NULL
            GROUP BY s1_idx, pool_idx
        ), ranked AS (
            SELECT s1_idx, pool_idx, ROW_NUMBER() OVER (PARTITION BY s1_idx ORDER BY bscore DESC, pool_idx) AS r FROM best
        )
        SELECT s1_idx, pool_idx FROM ranked WHERE r <= 10
    """,
}
