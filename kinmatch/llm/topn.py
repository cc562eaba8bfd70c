"""Problem 2: the N best items of every group."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a task gathers before it reduces them to the N best of each group.
COMPACT_ROWS = 200_000


def _best(pdf: pd.DataFrame, n: int) -> pd.DataFrame:
    """The N best distinct items of each group of ``pdf``: columns g, i, s; best first."""
    pdf = pdf.sort_values(["g", "s", "i"], ascending=[True, False, True], kind="mergesort")
    pdf = pdf.drop_duplicates(["g", "i"])
    return pdf[pdf.groupby("g", sort=False).cumcount() < n]


def _local(n: int):
    """Rows of one partition that can be among the N best of their group, with the partition's bound.

    The N-th best score among *distinct* items of a partition never exceeds the N-th best of the whole group, so
    it is a lower bound. State: at most N rows a group of this partition, plus COMPACT_ROWS.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        rows, floor = 0, 0
        for b in batches:
            kept.append(b)
            rows += len(b)
            if rows - floor > max(COMPACT_ROWS, floor):
                kept = [_best(pd.concat(kept, ignore_index=True), n)]
                rows = floor = len(kept[0])
        if not rows:
            return
        best = _best(pd.concat(kept, ignore_index=True), n)
        nth = best[best.groupby("g", sort=False).cumcount() == n - 1].set_index("g")["s"]
        best["b"] = best["g"].map(nth).astype("float64")
        for at in range(0, len(best), 50_000):
            yield best.iloc[at : at + 50_000]

    return run


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int = 10) -> DataFrame:
    """The ``n`` highest-scoring items of every group, ties by the smaller item; columns group, item, score, rank.

    Three steps: each partition reduces its rows to its own N best of every group and notes its N-th best score
    as a lower bound; the greatest bound of a group is joined to the group's rows and drops those below it; the
    survivors are ranked. A group that holds a third of the table leaves each partition with N rows, so the
    shuffle carries at most N rows a group and partition, and the ranking task reads what the bounds left over.
    Bound and rank share one exchange: both are keyed by the group.

    NULL or NaN scores, NULL groups and NULL items do not count. An item that occurs more than once in a group
    counts once, with its highest score. Groups without any counting row do not appear; an empty table gives none.
    Other columns are ignored, whatever their names.
    """
    kind = dict(df.dtypes)
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s")).where(
        F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s")
    )
    schema = T.StructType([*rows.schema.fields, T.StructField("b", T.DoubleType())])
    local = rows.mapInPandas(_local(n), schema).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    by_group = Window.partitionBy("g")
    alive = local.withColumn("bound", F.max("b").over(by_group)).where(F.col("bound").isNull() | (F.col("s") >= F.col("bound")))
    # One item can come from several partitions: only its best copy is ranked.
    first = Window.partitionBy("g", "i").orderBy(F.desc("s"))
    once = alive.withColumn("copy", F.row_number().over(first)).where("copy = 1")
    ranked = once.withColumn("rank", F.row_number().over(by_group.orderBy(F.desc("s"), F.asc("i")))).where(F.col("rank") <= n)
    return ranked.select(F.col("g").cast(kind[group]).alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
