"""Problem 5: per-key results although a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_states(df: DataFrame, keys: list[str], sums: list[str] | None = None) -> DataFrame:
    """One compact state a key: ``keys``, ``n`` (rows) and ``sum_<c>`` of every column in ``sums``.

    The aggregate runs in two steps, before and after the shuffle, so a key that holds most rows reaches its final
    task as one state from each partition. NULL is a key of its own; NULL values add nothing, and a key without
    any value has the sum 0.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"sum_{c}") for c in sums or []])


def heavy_keys(df: DataFrame, key: str, share: float = 0.05) -> DataFrame:
    """The values of ``key`` with more than ``share`` of all rows: ``key, n, share``. NULL counts as a value.

    Built on ``key_states``: the total is the sum of the states, so the table is read once for each. An empty
    table has no heavy keys. At most 1 / share rows come out.
    """
    states = key_states(df, [key])
    total = states.agg(F.sum("n").alias("total"))
    # One row, whatever the data: the broadcast side of this join is a single number.
    return states.join(F.broadcast(total)).where(F.col("n") > share * F.col("total")).select(key, "n", (F.col("n") / F.col("total")).alias("share"))


def eager_join_rollup(left: DataFrame, right: DataFrame, join_keys: list[str], roll_up: list[str], left_sums: list[str] | None = None, right_sums: list[str] | None = None) -> DataFrame:
    """Aggregates over ``left JOIN right`` per ``roll_up`` (some of the join keys) without building the joined rows.

    Both inputs are reduced to one state a join key, the states are joined, and the result follows algebraically:
    a key with a rows on the left and b on the right has a * b joined rows; a left sum counts b times, a right sum
    a times. Columns: ``roll_up, n_left, n_right`` (rows with a partner), ``n_joined``, ``sum_left_<c>``,
    ``sum_right_<c>`` over the joined rows.

    No task sees more rows of a key than there are partitions, however skewed the key is; the join itself has at
    most one row a key on each side. NULL keys match nothing, as in SQL; empty inputs give no rows.
    """
    a = key_states(left.dropna(subset=join_keys), join_keys, left_sums).withColumnsRenamed({"n": "n_a", **{f"sum_{c}": f"a_{c}" for c in left_sums or []}})
    b = key_states(right.dropna(subset=join_keys), join_keys, right_sums).withColumnsRenamed({"n": "n_b", **{f"sum_{c}": f"b_{c}" for c in right_sums or []}})
    return (
        a.join(b, join_keys)
        .groupBy(*roll_up)
        .agg(
            F.sum("n_a").alias("n_left"),
            F.sum("n_b").alias("n_right"),
            F.sum(F.col("n_a") * F.col("n_b")).alias("n_joined"),
            *[F.sum(F.col(f"a_{c}") * F.col("n_b")).alias(f"sum_left_{c}") for c in left_sums or []],
            *[F.sum(F.col(f"b_{c}") * F.col("n_a")).alias(f"sum_right_{c}") for c in right_sums or []],
        )
    )


def records_per_group(df: DataFrame, key: str, inner: str) -> DataFrame:
    """Per ``key``: ``n_rows``, ``n_values`` (distinct non-NULL ``inner``) and ``max_rows`` of one value.

    Aggregated by (key, inner) first, so the rows of a heavy key spread over its inner values.
    """
    fine = key_states(df, [key, inner])
    return fine.groupBy(key).agg(F.sum("n").alias("n_rows"), F.count(inner).alias("n_values"), F.coalesce(F.max(F.when(F.col(inner).isNotNull(), F.col("n"))), F.lit(0)).alias("max_rows"))
