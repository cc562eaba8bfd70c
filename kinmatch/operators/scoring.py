"""Gradient-boosted pair scoring: reranker, two-fold cross fitting, two-stage resolution."""

from __future__ import annotations

import secrets
from dataclasses import dataclass

import numpy as np
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmatch.core.session import cut, release
from kinmatch.operators import boosting, decision, pairs
from kinmatch.operators.boosting import Trees

NOT_FEATURES = {"s1_idx", "pool_idx", "y", "fold"}
RERANK_FEATURES = ["bscore", "n_keys", "rk", "name_ratio", "name_tset", "addr_tset", "addr_ratio", "addr_empty"]


def feature_columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[str]:
    """All columns but keys, label and fold, and those that contain one of ``without``."""
    return [c for c in df.columns if c not in NOT_FEATURES and not any(w in c for w in without)]


def fit_each(parts: list[DataFrame], cols: list[str], rounds: int = 600, depth: int = 5, step: float = 0.1, valid_share: float = 0.05, seed: int = 42) -> list[Trees]:
    """``fit`` of every table, all at the same time."""
    ready, cores = [], boosting.slots(parts[0].sparkSession)
    for df in parts:
        key = F.xxhash64("s1_idx", "pool_idx") if "pool_idx" in df.columns else F.xxhash64("s1_idx", *cols)
        valid = decision.bucket(F.col("s1_idx"), 3, 1000) < round(valid_share * 1000)
        rows = df.na.fill(0.0, cols).select(*[F.col(c).cast("double").alias(c) for c in cols], F.col("y").cast("double").alias("_y"), valid.alias("_valid"), key.alias("_key"))
        # Written once: it is read for the bins, and for the training.
        rows = cut(rows)
        share = [i / (boosting.BINS - 1) for i in range(boosting.BINS - 1)]
        seen = [F.count_if(~F.col("_valid") & (F.col("_y") == y)).alias(f"n{y}") for y in (0, 1)]
        one = rows.agg(F.count(F.lit(1)).alias("n"), *seen, *[F.percentile_approx(c, share, 10_000).alias(f"e{i}") for i, c in enumerate(cols)]).first()
        if not one["n0"] or not one["n1"]:
            raise ValueError("training needs both labels")
        edges = [np.unique(one[f"e{i}"]) for i in range(len(cols))]
        ranks = max(1, min(cores // len(parts), -(-one["n"] // boosting.TASK_ROWS)))
        work = boosting.training(edges, float(np.log(one["n1"] / one["n0"])), one["n"] > one["n0"] + one["n1"], rounds, depth, step, seed, ranks, secrets.token_bytes(16))
        ready.append((rows, work, ranks))
    models: list[Trees | Exception] = [ValueError("not trained")] * len(ready)

    def run(i: int) -> None:
        try:
            models[i] = boosting.trained(*ready[i])
        except Exception as e:
            models[i] = e

    threads = [InheritableThread(target=run, args=(i,)) for i in range(len(ready))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    for (rows, _, _), m in zip(ready, models, strict=True):
        release(rows)
        if isinstance(m, Exception):
            raise m
    return models


def fit(df: DataFrame, cols: list[str], rounds: int = 600, depth: int = 5, step: float = 0.1, valid_share: float = 0.05, seed: int = 42) -> Trees:
    """A boosted-tree classifier of ``y`` of up to ``rounds`` trees; a hashed share of entities is held out and ends the
    training where ``boosting.PATIENCE`` further trees do not help it. One job, however many trees.

    NULL features count as 0. Raises ValueError where the training rows have only one label.
    """
    return fit_each([df], cols, rounds, depth, step, valid_share, seed)[0]


def predict(model: Trees, df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """``df`` with the probability of a match in column ``name``."""
    filled = df.na.fill(0.0, cols)
    return filled.select(*df.columns, model.column(cols).alias(name))


def save_model(model: Trees, path: str) -> None:
    """Write the model to a folder."""
    SparkSession.active().createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(path: str) -> Trees:
    """The model that ``save_model`` wrote."""
    return Trees.from_json(SparkSession.active().read.text(path).first()["value"])


def labelled(df: DataFrame, pool: DataFrame, n_folds: int = 2, salt: int = 42) -> DataFrame:
    """Pairs with ``y`` (the pool record belongs to the Source 1 record) and ``fold`` (by entity)."""
    return df.join(pool.select(F.col("idx").alias("pool_idx"), "gid"), "pool_idx").withColumns({"y": (F.col("gid") == F.col("s1_idx")).cast("tinyint"), "fold": decision.bucket(F.col("s1_idx"), salt, n_folds).cast("tinyint")}).drop("gid")


def train_reranker(cands: DataFrame, s1: DataFrame, pool: DataFrame, rounds: int = 200) -> Trees:
    """The small model of the second retrieval pass, from all given candidates (``pipeline.rerank_recall`` measures one on half of the entities)."""
    return fit(labelled(pairs.rerank_features(cands, s1, pool), pool), RERANK_FEATURES, rounds)


def rerank(cands: DataFrame, s1: DataFrame, pool: DataFrame, model: Trees, keep: int) -> DataFrame:
    """``cands`` with ``rr``, the ``keep`` best per Source 1 record; ties to the smaller ``pool_idx``."""
    f = predict(model, pairs.rerank_features(cands, s1, pool), RERANK_FEATURES, "rr")
    w = Window.partitionBy("s1_idx").orderBy(F.desc("rr"), "pool_idx")
    return f.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).select(*cands.columns, "rr")


@dataclass
class CrossFit:
    """Two models, each fitted on one fold of entities."""

    models: dict[int, Trees]
    columns: list[str]

    def out_of_fold(self, df: DataFrame, name: str) -> DataFrame:
        """Every row scored by the model that has not seen its entity."""
        parts = [predict(self.models[1 - k], df.where(F.col("fold") == k), self.columns, name) for k in (0, 1)]
        return parts[0].unionByName(parts[1])

    def mean(self, df: DataFrame, name: str) -> DataFrame:
        """Every row scored by the mean of both models, for entities that neither has seen."""
        both = predict(self.models[1], predict(self.models[0], df, self.columns, "_p0"), self.columns, "_p1")
        return both.withColumn(name, (F.col("_p0") + F.col("_p1")) / 2).drop("_p0", "_p1")


def cross_fit(df: DataFrame, cols: list[str], rounds: int = 600) -> CrossFit:
    """One model per fold of ``df`` (``y``, ``fold`` 0 or 1)."""
    return CrossFit(dict(enumerate(fit_each([df.where(F.col("fold") == k) for k in (0, 1)], cols, rounds))), cols)


def two_stage(features: DataFrame, prune: float = 0.01, rounds: int = 600, sample: float = 1.0, pool_context: bool = True) -> tuple[DataFrame, CrossFit, CrossFit]:
    """(scores ``s1_idx, pool_idx, p1, p2, y, fold``, stage 1, stage 2), all out of fold.

    Stage 1 is fitted on a hashed share of the entities and scores every pair; pairs from ``prune`` on get competition
    features and a second model. Without ``pool_context`` it does not see who else competes for the pool record.
    """
    first = cross_fit(decision.subset(features, "s1_idx", sample, 1) if sample < 1 else features, feature_columns(features), rounds)
    kept = ["s1_idx", "pool_idx", "y", "fold", "p1", *[c for c in KEPT if c in features.columns]]
    p1 = cut(first.out_of_fold(features, "p1").where(F.col("p1") >= prune).select(*kept))
    ctx = cut(pairs.stage2_context(p1, "p1"))
    columns = feature_columns(ctx, () if pool_context else ("p1_rank_pool", "p1_gap_pool", "p1_sum_pool", "p1_n05_pool", "best_other"))
    second = cross_fit(ctx, columns, rounds)
    return second.out_of_fold(ctx, "p2").select("s1_idx", "pool_idx", "p1", "p2", "y", "fold"), first, second


# Raw features that the second stage keeps.
KEPT = ("bscore", "b_rank_s1", "b_rank_pool", "name_tset", "name_ratio", "addr_tset", "addr_ratio", "jac_name_tok", "jac_addr_num", "deva_b", "src_b", "len_addr_b")


def best_rule(scores: DataFrame, entities: DataFrame, pool: DataFrame, p: str = "p2") -> dict:
    """The decision rule of the highest macro F: thresholds 0.20 to 0.95 with and without exclusiveness, or expected F."""
    # The thresholds, and the ``extra`` expected matches below.
    grid = [round(0.05 * i, 2) for i in range(4, 20)]
    best = decision.threshold_sweep(scores, entities, pool, grid, p).orderBy(F.desc("f05"), "thr", "only_best").first()
    rule = {"kind": "threshold", "thr": best["thr"], "only_best": best["only_best"], "f05": best["f05"]}
    one = decision.exclusive(scores, p)
    for extra in (0.0, 0.1, 0.3):
        got = decision.macro_f(decision.per_entity(decision.expected_f(one, p, extra=extra), entities, pool)).first()["f05"]
        if got is not None and got > rule["f05"]:
            rule = {"kind": "expected_f", "extra": extra, "f05": got}
    return rule


def apply_rule(scores: DataFrame, rule: dict, p: str = "p2") -> DataFrame:
    """``s1_idx, pool_idx`` that a rule of ``best_rule`` accepts."""
    if rule["kind"] == "threshold":
        return decision.decide(scores, rule["thr"], p, rule["only_best"])
    return decision.expected_f(decision.exclusive(scores, p), p, extra=rule["extra"])
