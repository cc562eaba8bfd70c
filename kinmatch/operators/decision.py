"""From pair scores to matches, and how good matches and candidates are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(key: Column, salt: int, n: int) -> Column:
    """A number from 0 to n - 1 that depends on the key and the salt only: the first eight hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string"))), 1, 8), 16, 10).cast("bigint") % n


def subset(df: DataFrame, key: str, share: float, salt: int = 5) -> DataFrame:
    """The rows whose key falls into the first ``share`` of 1,000 buckets."""
    return df.where(bucket(F.col(key), salt, 1000) < round(share * 1000))


def exclusive(scores: DataFrame, p: str) -> DataFrame:
    """Each pool record's best pair; ties to the smaller ``s1_idx``."""
    w = Window.partitionBy("pool_idx").orderBy(F.desc(p), "s1_idx")
    return scores.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def decide(scores: DataFrame, threshold: float, p: str = "p", only_best: bool = True) -> DataFrame:
    """``s1_idx, pool_idx`` of pairs from ``threshold`` on; with ``only_best`` a pool record goes to its best Source 1 record."""
    kept = scores.where(F.col(p) >= threshold)
    return (exclusive(kept, p) if only_best else kept).select("s1_idx", "pool_idx")


def expected_f(scores: DataFrame, p: str = "p", beta: float = 0.5, extra: float = 0.0, min_p: float = 0.05, empty_scale: float = 1.0) -> DataFrame:
    """``s1_idx, pool_idx``: for every Source 1 record the k best pairs with the highest expected F.

    E(k) = (1 + b²) Σp / (k + b² (Σ all p + extra)) over pairs with p >= ``min_p``; the empty answer has the
    probability that no candidate matches, over all given candidates. The smallest best k wins, and only if it
    beats the empty answer. One window pass over the Source 1 record; no join.
    """
    b2 = beta * beta
    by_s1 = Window.partitionBy("s1_idx")
    order = by_s1.orderBy(F.desc(p), "pool_idx")
    none = F.exp(F.sum(F.log(F.greatest(F.least(1 - F.col(p), F.lit(1.0)), F.lit(1e-9)))).over(by_s1)) * empty_scale
    use = F.col(p) >= min_p
    d = scores.withColumns({"_e0": none, "_n": F.sum(F.when(use, F.col(p))).over(by_s1) + extra}).where(use)
    d = d.withColumns({"_k": F.row_number().over(order), "_tp": F.sum(p).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    d = d.withColumn("_ef", F.round((1 + b2) * F.col("_tp") / (F.col("_k") + b2 * F.col("_n")), 12))
    d = d.withColumn("_best", F.min(F.struct((-F.col("_ef")).alias("e"), F.col("_k").alias("k"))).over(by_s1))
    return d.where((-F.col("_best.e") > F.col("_e0")) & (F.col("_k") <= F.col("_best.k"))).select("s1_idx", "pool_idx")


def per_entity(pred: DataFrame, entities: DataFrame, pool: DataFrame) -> DataFrame:
    """``s1_idx, n_true, n_pred, tp`` of every entity; ``pool`` has ``idx`` and ``gid``."""
    truth = pool.where("gid >= 0").groupBy(F.col("gid").alias("s1_idx")).agg(F.count(F.lit(1)).alias("n_true"))
    got = pred.join(pool.select(F.col("idx").alias("pool_idx"), "gid"), "pool_idx", "left").groupBy("s1_idx").agg(F.count(F.lit(1)).alias("n_pred"), F.count_if(F.col("gid") == F.col("s1_idx")).alias("tp"))
    return entities.select("s1_idx").join(truth, "s1_idx", "left").join(got, "s1_idx", "left").na.fill(0, ["n_true", "n_pred", "tp"])


def _f(prec: Column, rec: Column, b2: float) -> Column:
    return F.when(prec + rec > 0, (1 + b2) * prec * rec / (b2 * prec + rec)).otherwise(F.lit(0.0))


def macro_f(per: DataFrame, beta: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """The macro F of ``per_entity`` rows and seven figures beside it, one row (or one per ``by``).

    Nothing predicted and nothing true scores 1; something predicted where nothing is true, or nothing where
    something is, 0. A figure without any entity to average is NULL.
    """
    b2 = beta * beta
    n_pred, n_true, tp = F.col("n_pred"), F.col("n_true"), F.col("tp")
    prec = F.when(n_pred > 0, tp / n_pred).otherwise(F.lit(0.0))
    rec = F.when(n_true > 0, tp / n_true).otherwise(F.lit(0.0))
    f = F.when((n_pred == 0) & (n_true == 0), F.lit(1.0)).otherwise(_f(prec, rec, b2))
    flag = lambda c: c.cast("double")
    return per.withColumn("_f", f).groupBy(*(by or [])).agg(
        F.avg("_f").alias("f05"),
        F.avg(F.when(n_pred > 0, prec).otherwise(flag(n_true == 0))).alias("precision_macro"),
        F.avg(F.when(n_true > 0, rec).otherwise(flag(n_pred == 0))).alias("recall_macro"),
        F.avg(F.when(n_true == 0, F.col("_f"))).alias("singleton_acc"),
        F.avg(F.when(n_true > 0, F.col("_f"))).alias("nonsingleton_f05"),
        (F.sum(tp) / F.greatest(F.sum(n_pred), F.lit(1))).alias("pair_precision"),
        (F.sum(tp) / F.greatest(F.sum(n_true), F.lit(1))).alias("pair_recall"),
        F.count(F.lit(1)).alias("n_entities"),
    )


def blocking_report(cands: DataFrame, entities: DataFrame, pool: DataFrame) -> DataFrame:
    """One row: how much of the truth the candidates hold, how many they are, and the F 0.5 of a perfect model on them."""
    per = per_entity(cands.join(entities.select("s1_idx"), "s1_idx", "left_semi"), entities, pool)
    rec = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(F.lit(1.0))
    n_pred = F.when(F.col("n_pred") > 0, F.col("n_pred"))
    return per.agg(
        (F.sum("tp") / F.greatest(F.sum("n_true"), F.lit(1))).alias("pair_recall"),
        F.sum("n_true").alias("true_pairs"),
        F.sum("n_pred").alias("cand_pairs"),
        F.coalesce(F.avg(n_pred), F.lit(0.0)).alias("mean_cands"),
        F.coalesce(F.median(n_pred), F.lit(0.0)).alias("median_cands"),
        F.coalesce(F.max(n_pred), F.lit(0)).alias("max_cands"),
        F.count_if(F.col("n_pred") == 0).alias("s1_zero_cands"),
        F.avg(F.when(F.col("n_true") == 0, F.lit(1.0)).otherwise(1.25 * rec / (0.25 + rec))).alias("f05_ceiling"),
    )


def recall_at(cands: DataFrame, pool: DataFrame, ks: list[int], score: str = "bscore") -> DataFrame:
    """``k, recall`` for every k: the share of true pairs among each record's k best candidates. One pass for all k."""
    w = Window.partitionBy("s1_idx").orderBy(F.desc(score), "pool_idx")
    hits = cands.withColumn("_r", F.row_number().over(w)).join(pool.select(F.col("idx").alias("pool_idx"), "gid"), "pool_idx").where("gid = s1_idx")
    total = pool.agg(F.count_if(F.col("gid") >= 0).alias("total"))
    found = hits.agg(*[F.count_if(F.col("_r") <= k).alias(f"k{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("hits")) for k in ks])
    return found.join(F.broadcast(total)).select(F.inline(rows), "total").select("k", (F.col("hits") / F.greatest("total", F.lit(1))).alias("recall"))


def threshold_sweep(scores: DataFrame, entities: DataFrame, pool: DataFrame, thresholds: list[float], p: str = "p", beta: float = 0.5) -> DataFrame:
    """``thr, only_best`` and the macro F figures of every rule, in one job instead of one run per rule.

    A pool record's best pair passes a threshold whenever any of its pairs does, so exclusiveness is settled once.
    The counts of all rules are columns of one row an entity; only that row is shuffled and joined. It is spread over the
    rules right before the last aggregate, which combines the rows of a rule where they arise.
    """
    ranked = scores.withColumn("_r", F.row_number().over(Window.partitionBy("pool_idx").orderBy(F.desc(p), "s1_idx")))
    lab = ranked.join(pool.select(F.col("idx").alias("pool_idx"), "gid"), "pool_idx", "left")
    counts, cells = [], []
    for i, t in enumerate(thresholds):
        for only in (True, False):
            passes = (F.col(p) >= t) & (F.col("_r") == 1) if only else F.col(p) >= t
            n, hit = f"_n{i}{only}", f"_t{i}{only}"
            counts += [F.count_if(passes).alias(n), F.count_if(passes & (F.col("gid") == F.col("s1_idx"))).alias(hit)]
            cells.append(F.struct(F.lit(t).alias("thr"), F.lit(only).alias("only_best"), F.coalesce(n, F.lit(0)).alias("n_pred"), F.coalesce(hit, F.lit(0)).alias("tp")))
    got = lab.groupBy("s1_idx").agg(*counts)
    truth = pool.where("gid >= 0").groupBy(F.col("gid").alias("s1_idx")).agg(F.count(F.lit(1)).alias("n_true"))
    per = entities.select("s1_idx").join(truth, "s1_idx", "left").join(got, "s1_idx", "left")
    return macro_f(per.select(F.coalesce("n_true", F.lit(0)).alias("n_true"), F.inline(F.array(*cells))), beta, ["thr", "only_best"])
