"""Connected components of a link table, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.core.session import cut, release


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node that occurs in ``links``; a component is named after its smallest node.

    Alternating large and small stars: every round replaces a node's links by links to the smallest node it can
    see, once for its larger neighbours and once for its smaller ones, so paths shrink by halves and a node of very
    many links never gathers them in one place (minima are partial aggregates; the rest is row by row). Each round
    is written to the shared checkpoint folder, which cuts the lineage and survives lost executors.

    NULL ends and links of a node to itself add no link; an empty table gives no rows. Raises if ``max_rounds``
    does not suffice, which needs paths of length 2 ** max_rounds.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def stars(edges: DataFrame) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: larger neighbours move to the smallest node in sight.
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: smaller neighbours and the node itself move to the smallest of them.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        return small.where("u <> v").distinct()

    def sign(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    before = sign(e)
    for _ in range(max_rounds):
        last, e = e, cut(stars(e))
        now = sign(e)
        release(last)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.join(e.select(F.col("u").alias("node")).hint("merge"), "node", "left_anti")).dropDuplicates(["node"])
