"""Features of candidate pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions.similarity import similarities
from kinmatch.functions.text import numbers

_SIDE = ("name_norm", "addr_norm", "name_tok", "addr_tok", "name_deva", "src")


def side(df: DataFrame) -> DataFrame:
    """Record columns that pair features need: text, tokens, the name without blanks and the address's numbers."""
    src = F.col("src") if "src" in df.columns else F.lit(1).cast("tinyint").alias("src")
    return df.select("idx", *_SIDE[:-1], src, F.replace("name_norm", F.lit(" "), F.lit("")).alias("name_ns"), numbers(F.col("addr_tok")).alias("addr_num"))


def attach(pairs: DataFrame, s1: DataFrame, pool: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``pairs`` with the columns of both records, suffixed ``_a`` (Source 1) and ``_b`` (pool)."""
    a = s1.select(F.col("idx").alias("s1_idx"), *[F.col(c).alias(f"{c}_a") for c in columns or s1.columns if c != "idx"])
    b = pool.select(F.col("idx").alias("pool_idx"), *[F.col(c).alias(f"{c}_b") for c in columns or pool.columns if c != "idx"])
    return pairs.join(b, "pool_idx").join(a, "s1_idx")


def spread(pairs: DataFrame) -> DataFrame:
    """``pairs`` over all shuffle partitions, for work that costs far more than its bytes tell.

    Adaptive execution sizes partitions by bytes, so a few MB of pairs would be scored by a core or two. Only the narrow pairs are
    moved, and by the key of the join with the larger table.
    """
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pool_idx")


def jaccard(a: Column, b: Column) -> tuple[Column, Column]:
    """(Jaccard index, number of common elements) of two lists as sets; two empty lists give 0."""
    common = F.size(F.array_intersect(a, b))
    return common / F.greatest(F.size(F.array_union(a, b)), F.lit(1)), common


def set_features(joined: DataFrame) -> dict[str, Column]:
    """The 16 features from sets, lengths and flags, over the columns of ``attach``."""
    out: dict[str, Column] = {}
    for c in ("name_tok", "addr_tok", "addr_num"):
        out[f"jac_{c}"], out[f"ncommon_{c}"] = jaccard(F.col(f"{c}_a"), F.col(f"{c}_b"))
    out["first_tok_eq"] = F.get("name_tok_a", F.lit(0)) == F.get("name_tok_b", F.lit(0))
    for field in ("name", "addr"):
        for s in ("a", "b"):
            out[f"len_{field}_{s}"] = F.char_length(f"{field}_norm_{s}")
    out["nnum_a"], out["nnum_b"] = F.size("addr_num_a"), F.size("addr_num_b")
    out["num_a_subset_b"] = F.size(F.array_except("addr_num_a", "addr_num_b")) == 0
    out["deva_b"], out["src_b"] = F.col("name_deva_b"), F.col("src_b")
    return {k: v.cast("double") for k, v in out.items()}


#: Feature -> (scorer, record column).
SIMILARITIES = {
    "name_ratio": ("ratio", "name_norm"), "name_tsort": ("token_sort", "name_norm"), "name_tset": ("token_set", "name_norm"), "name_partial": ("partial", "name_norm"),
    "name_jw": ("jaro_winkler", "name_norm"), "name_ns_ratio": ("ratio", "name_ns"), "name_ns_partial": ("partial", "name_ns"),
    "addr_ratio": ("ratio", "addr_norm"), "addr_tsort": ("token_sort", "addr_norm"), "addr_tset": ("token_set", "addr_norm"), "addr_partial": ("partial", "addr_norm"),
}


#: Columns of ``pair_features`` beside the keys.
PAIR_FEATURES = [
    "bscore", "n_keys", *[f"{k}_{c}" for c in ("name_tok", "addr_tok", "addr_num") for k in ("jac", "ncommon")], "first_tok_eq", *[f"len_{f}_{s}" for f in ("name", "addr") for s in ("a", "b")],
    "nnum_a", "nnum_b", "num_a_subset_b", "deva_b", "src_b", *SIMILARITIES,
]


def pair_features(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """``s1_idx, pool_idx`` and 29 features: bscore, n_keys, 16 from sets and lengths, 11 similarities.

    Two equi-joins and one trip to Python for all similarities of a pair. NULL texts count as empty.
    """
    joined = attach(spread(pairs), side(s1), side(pool))
    sims = similarities({k: (s, F.col(f"{c}_a"), F.col(f"{c}_b")) for k, (s, c) in SIMILARITIES.items()})
    wide = joined.select("s1_idx", "pool_idx", F.col("bscore").cast("double").alias("bscore"), F.col("n_keys").cast("double").alias("n_keys"), *[v.alias(k) for k, v in set_features(joined).items()], sims.alias("_s"))
    return wide.select(*[c for c in wide.columns if c != "_s"], "_s.*")


def rerank_features(pairs: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """``pairs`` with the reranker's columns: rank by bscore, four similarities, and whether the pool address is empty."""
    joined = attach(spread(pairs), s1, pool, ["name_norm", "addr_norm"])
    col = lambda c: (F.col(f"{c}_a"), F.col(f"{c}_b"))
    sims = similarities({"name_ratio": ("ratio", *col("name_norm")), "name_tset": ("token_set", *col("name_norm")), "addr_tset": ("token_set", *col("addr_norm")), "addr_ratio": ("ratio", *col("addr_norm"))})
    rank = F.row_number().over(Window.partitionBy("s1_idx").orderBy(F.desc("bscore"), "pool_idx"))
    scored = joined.withColumns({"_s": sims, "addr_empty": (F.char_length("addr_norm_b") == 0).cast("double")})
    return scored.select(*pairs.columns, "_s.*", "addr_empty").withColumn("rk", rank.cast("double"))


def group_features(df: DataFrame, score: str = "bscore", prefix: str = "b") -> DataFrame:
    """Context of a score: rank and gap to the best (never positive) among the Source 1 record's pairs and among the
    pool record's pairs, and the number of Source 1 records competing for the pool record. Ties by the other id.

    Windows of one key share one exchange; two exchanges in all.
    """
    s = F.col(score)
    by_s1, by_pool = Window.partitionBy("s1_idx"), Window.partitionBy("pool_idx")
    return df.withColumns(
        {
            f"{prefix}_rank_s1": F.row_number().over(by_s1.orderBy(F.desc(score), "pool_idx")).cast("double"),
            f"{prefix}_gap_s1max": s - F.max(s).over(by_s1),
            f"{prefix}_rank_pool": F.row_number().over(by_pool.orderBy(F.desc(score), "s1_idx")).cast("double"),
            f"{prefix}_gap_poolmax": s - F.max(s).over(by_pool),
            f"{prefix}_n_s1_for_pool": F.count(F.lit(1)).over(by_pool).cast("double"),
        }
    )


def stage2_context(df: DataFrame, p: str = "p1") -> DataFrame:
    """Competition features of a probability: ranks, gaps to the best (never negative), sums and counts over 0.5 on both
    sides, and the best probability that another Source 1 record has for the same pool record (0 without one)."""
    s = F.col(p)
    by_s1, by_pool = Window.partitionBy("s1_idx"), Window.partitionBy("pool_idx")
    order = by_pool.orderBy(F.desc(p), "s1_idx")
    out = df.withColumns(
        {
            f"{p}_rank_s1": F.row_number().over(by_s1.orderBy(F.desc(p), "pool_idx")).cast("double"),
            f"{p}_gap_s1max": F.max(s).over(by_s1) - s,
            f"{p}_sum_s1": F.sum(s).over(by_s1),
            f"{p}_n05_s1": F.count_if(s > 0.5).over(by_s1).cast("double"),
            f"{p}_rank_pool": F.row_number().over(order).cast("double"),
            f"{p}_gap_poolmax": F.max(s).over(by_pool) - s,
            f"{p}_sum_pool": F.sum(s).over(by_pool),
            f"{p}_n05_pool": F.count_if(s > 0.5).over(by_pool).cast("double"),
        }
    )
    rank = F.col(f"{p}_rank_pool")
    first, second = F.max(F.when(rank == 1, s)).over(by_pool), F.max(F.when(rank == 2, s)).over(by_pool)
    # The best itself, and whoever ties with it, faces the second; all others face the best.
    return out.withColumn(f"{p}_best_other_s1", F.coalesce(F.when(s >= first, second).otherwise(first), F.lit(0.0)))


def name_counts(s1: DataFrame, pool: DataFrame, all_s1: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables' ``idx, country_norm, name_tok`` with the number of Source 1 and of pool records of the same country and name.

    Records of ``all_s1`` that are not in ``s1`` get the counts too, without being counted.
    """
    key = ["country_norm", "name_norm"]
    c1 = s1.groupBy(*key).agg(F.count(F.lit(1)).alias("n_s1_same_name"))
    c2 = pool.groupBy(*key).agg(F.count(F.lit(1)).alias("n_pool_same_name"))

    def one(df: DataFrame) -> DataFrame:
        return df.select("idx", "name_tok", *key).join(c1, key, "left").join(c2, key, "left").select("idx", "country_norm", "name_tok", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("n_s1_same_name", "n_pool_same_name")])

    return one(s1 if all_s1 is None else all_s1), one(pool)


def token_idf(s1: DataFrame, pool: DataFrame) -> DataFrame:
    """``country_norm, tok, idf`` of name words over both tables: ln((N + 1) / (n + 1)), N records of the country, n of them with the word."""
    both = s1.select("country_norm", "name_tok").unionByName(pool.select("country_norm", "name_tok"))
    n = both.groupBy("country_norm").agg(F.count(F.lit(1)).alias("n_records"))
    df = both.select("country_norm", F.explode(F.array_distinct("name_tok")).alias("tok")).groupBy("country_norm", "tok").agg(F.count(F.lit(1)).alias("n"))
    return df.join(n, "country_norm").select("country_norm", "tok", F.log((F.col("n_records") + 1) / (F.col("n") + 1)).alias("idf"))


def name_evidence(pairs: DataFrame, s1: DataFrame, pool: DataFrame, present: DataFrame | None = None, unseen: float = math.log(1e6)) -> DataFrame:
    """12 features of how telling the shared and unshared name words of a pair are; columns ``s1_idx, pool_idx`` and the features.

    Sums and maxima of idf of shared, Source 1 only and pool only words (idf of the Source 1 record's country,
    ``unseen`` for unknown words, 0 without words), their idf Jaccard, the similarity of what is left over (100 if
    nothing is), and the four same-name counts. ``present`` (``idx``) restricts which Source 1 records are counted.
    Every record carries its own words' idf as a map, so pairs need no exploded join.
    """
    counted = s1 if present is None else s1.join(present.select("idx"), "idx", "left_semi")
    n1, n2 = name_counts(counted, pool, s1)
    idf = token_idf(counted, pool)

    def with_map(df: DataFrame) -> DataFrame:
        toks = df.select("idx", "country_norm", F.explode(F.array_distinct("name_tok")).alias("tok")).join(idf, ["country_norm", "tok"], "left")
        maps = toks.groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("tok", F.coalesce("idf", F.lit(unseen)).alias("idf")))).alias("idfs"))
        return df.join(maps, "idx", "left")

    a = with_map(n1).select(F.col("idx").alias("s1_idx"), F.col("country_norm").alias("ca"), F.col("name_tok").alias("ta"), F.col("idfs").alias("ia"), F.col("n_s1_same_name").alias("n_s1_same_name_a"), F.col("n_pool_same_name").alias("n_pool_same_name_a"))
    b = with_map(n2).select(F.col("idx").alias("pool_idx"), F.col("country_norm").alias("cb"), F.col("name_tok").alias("tb"), F.col("idfs").alias("ib"), F.col("n_s1_same_name").alias("n_s1_same_name_b"), F.col("n_pool_same_name").alias("n_pool_same_name_b"))
    d = spread(pairs.select("s1_idx", "pool_idx")).join(b, "pool_idx").join(a, "s1_idx")
    # Pool words take the idf of the Source 1 record's country. The pool record's own map holds it where both are of one
    # country; the few pairs across countries look their words up there.
    abroad = d.where(~F.col("ca").eqNullSafe(F.col("cb"))).select("s1_idx", "pool_idx", F.col("ca").alias("country_norm"), F.explode(F.array_except("tb", "ta")).alias("tok"))
    foreign = abroad.join(idf, ["country_norm", "tok"], "left").groupBy("s1_idx", "pool_idx").agg(F.map_from_entries(F.collect_set(F.struct("tok", F.coalesce("idf", F.lit(unseen)).alias("idf")))).alias("_if"))
    d = d.join(foreign, ["s1_idx", "pool_idx"], "left").withColumn("ib", F.when(F.col("ca").eqNullSafe(F.col("cb")), F.col("ib")).otherwise(F.col("_if")))
    d = d.withColumns({"sh": F.array_intersect("ta", "tb"), "ao": F.array_except("ta", "tb"), "bo": F.array_except("tb", "ta")})
    look = lambda c, m: F.transform(c, lambda t: F.coalesce(F.try_element_at(m, t), F.lit(unseen)))
    vals = {"shared": look("sh", F.col("ia")), "s1only": look("ao", F.col("ia")), "poolonly": look("bo", F.col("ib"))}
    cols: dict[str, Column] = {}
    for k, v in vals.items():
        cols[f"{k}_idf_sum"] = F.aggregate(v, F.lit(0.0), lambda x, y: x + y)
        cols[f"{k}_idf_max"] = F.coalesce(F.array_max(v), F.lit(0.0))
    d = d.withColumns(cols)
    total = F.col("shared_idf_sum") + F.col("s1only_idf_sum") + F.col("poolonly_idf_sum")
    left = similarities({"leftover_ratio": ("ratio", F.array_join("ao", " "), F.array_join("bo", " "))})
    return d.withColumns({"idf_jacc": F.col("shared_idf_sum") / F.greatest(total, F.lit(1e-6)), "_l": left}).select(
        "s1_idx", "pool_idx", *cols, "idf_jacc", F.when((F.size("ao") == 0) & (F.size("bo") == 0), F.lit(100.0)).otherwise(F.col("_l.leftover_ratio")).alias("leftover_ratio"),
        "n_s1_same_name_a", "n_pool_same_name_a", "n_s1_same_name_b", "n_pool_same_name_b",
    )
