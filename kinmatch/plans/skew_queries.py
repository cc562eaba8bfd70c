"""Queries and SQL of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.core.session import table
from kinmatch.operators import skew


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries with more than 5 % of the Source 1 records."""
    return skew.heavy_keys(table(spark, sf_dir, "train_s1"), "country_norm", 0.05).select("country_norm")


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and names of every country."""
    return skew.records_per_group(table(spark, sf_dir, "train_s1"), "country_norm", "name_norm")


def p5_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of Source 1 and pool records with the same country and name, counted per country without building them."""
    sized = [table(spark, sf_dir, t).select("country_norm", "name_norm", F.length("addr_norm").alias("addr_len")) for t in ("train_s1", "train_pool")]
    return skew.eager_join_rollup(*sized, ["country_norm", "name_norm"], ["country_norm"], ["addr_len"], ["addr_len"])


QUERIES = {f.__name__: f for f in (p5_found, p5_records, p5_join)}

SQL = {
    "p5_found": """
        SELECT country_norm FROM train_s1 GROUP BY country_norm
        HAVING COUNT(*) > 0.05 * (SELECT COUNT(*) FROM train_s1)
    """,
    "p5_records": """
        WITH fine AS (SELECT country_norm, name_norm, COUNT(*) AS n FROM train_s1 GROUP BY country_norm, name_norm)
        SELECT country_norm, CAST(SUM(n) AS BIGINT) AS n_rows, COUNT(name_norm) AS n_values,
               COALESCE(MAX(CASE WHEN name_norm IS NOT NULL THEN n END), 0) AS max_rows
        FROM fine GROUP BY country_norm
    """,
    "p5_join": """
        WITH a AS (SELECT country_norm, name_norm, COUNT(*) AS n, SUM(length(addr_norm)) AS s FROM train_s1 GROUP BY ALL),
             b AS (SELECT country_norm, name_norm, COUNT(*) AS n, SUM(length(addr_norm)) AS s FROM train_pool GROUP BY ALL)
        SELECT a.country_norm, CAST(SUM(a.n) AS BIGINT) AS n_left, CAST(SUM(b.n) AS BIGINT) AS n_right,
               CAST(SUM(a.n * b.n) AS BIGINT) AS n_joined,
               CAST(SUM(a.s * b.n) AS BIGINT) AS sum_left_addr_len, CAST(SUM(b.s * a.n) AS BIGINT) AS sum_right_addr_len
        FROM a JOIN b ON a.country_norm = b.country_norm AND a.name_norm = b.name_norm
        GROUP BY a.country_norm
    """,
}
