"""Candidate pairs from shared, rare keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Key kinds: one name word, one address word, two name words in any order, two neighbouring address words.
KINDS = ("n1", "a1", "nn", "ab")


def _entries(kind: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("t"), k.alias("key")))


def record_keys(df: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``idx, country_norm, t, key``, each key of a record once. Built within the row: no join, no shuffle.

    NULL or empty token lists give no keys of their kind.
    """
    name = F.array_sort(F.array_distinct(F.coalesce("name_tok", F.array().cast("array<string>"))))
    addr = F.coalesce("addr_tok", F.array().cast("array<string>"))
    built = {
        "n1": _entries("n1", name),
        "a1": _entries("a1", F.array_distinct(addr)),
        # The list is sorted, so a word before another is the smaller one.
        "nn": _entries("nn", F.flatten(F.transform(name, lambda x: F.transform(F.filter(name, lambda y: y > x), lambda y: F.concat_ws(" ", x, y))))),
        "ab": _entries("ab", F.array_distinct(F.zip_with(F.slice(addr, 1, F.greatest(F.size(addr) - 1, F.lit(0))), F.slice(addr, 2, F.greatest(F.size(addr) - 1, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y)))),
    }
    return df.select("idx", "country_norm", F.explode(F.concat(*[built[k] for k in kinds])).alias("e")).select("idx", "country_norm", "e.t", "e.key")


def key_idf(pool: DataFrame, caps: dict[str, int]) -> DataFrame:
    """``country_norm, t, key, df, idf`` of the pool's keys up to the document frequency cap of their kind.

    idf = ln(max(N, 2)) - ln(df), N the country's pool records.
    """
    cap = F.lit(None).cast("int")
    for kind, most in caps.items():
        cap = F.when(F.col("t") == kind, F.lit(most)).otherwise(cap)
    df = record_keys(pool, tuple(caps)).groupBy("country_norm", "t", "key").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= cap)
    n = pool.groupBy("country_norm").agg(F.count(F.lit(1)).alias("n_pool"))
    return df.join(n, "country_norm").select("country_norm", "t", "key", "df", (F.log(F.greatest("n_pool", F.lit(2))) - F.log("df")).alias("idf"))


def postings(pool: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The inverted index: ``country_norm, t, key, pool_idx, idf``.

    The count comes first and combines where the keys arise, so a key that most records have never gathers in one task; the
    keys within the cap are then joined to their records, which makes short lists only.
    """
    cap = F.lit(None).cast("int")
    for kind, most in caps.items():
        cap = F.when(F.col("t") == kind, F.lit(most)).otherwise(cap)
    keys = record_keys(pool, tuple(caps))
    rare = keys.groupBy("country_norm", "t", "key").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= cap)
    n = pool.groupBy("country_norm").agg(F.count(F.lit(1)).alias("n_pool"))
    with_idf = rare.join(n, "country_norm").select("country_norm", "t", "key", (F.log(F.greatest("n_pool", F.lit(2))) - F.log("df")).alias("idf"))
    return keys.join(with_idf, ["country_norm", "t", "key"]).withColumnRenamed("idx", "pool_idx")


def candidates(s1: DataFrame, pool: DataFrame, caps: dict[str, int], top_k: int = 50, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``s1_idx, pool_idx, bscore, n_keys``: pairs of one country with a rare key in common, the ``top_k`` best per Source 1 record.

    bscore is the sum of the shared keys' idf; ties go to the smaller ``pool_idx`` (scores compared to 9 digits).
    The country is a join key, not a loop, so all countries run at once. ``rerank`` maps pairs to pairs. Records
    without keys have no candidates.
    """
    index = postings(pool, caps)
    probe = record_keys(s1, tuple(caps)).withColumnRenamed("idx", "s1_idx")
    pairs = (
        probe.join(index, ["country_norm", "t", "key"])
        .groupBy("s1_idx", "pool_idx")
        .agg(F.sum("idf").alias("bscore"), F.count(F.lit(1)).alias("n_keys"))
    )
    best = Window.partitionBy("s1_idx").orderBy(F.desc(F.round("bscore", 9)), "pool_idx")
    top = pairs.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= top_k).drop("_r")
    return rerank(top) if rerank else top
