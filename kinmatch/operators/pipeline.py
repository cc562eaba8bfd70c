"""The whole linkage: all stage-1 features, training with a decision rule, evaluation, and matches for unseen records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.core.session import cut
from kinmatch.operators import blocking, decision, pairs, scoring
from kinmatch.sources.tables import Settings, id_lists

KEYS = ["s1_idx", "pool_idx"]


def feature_table(cands: DataFrame, s1: DataFrame, pool: DataFrame, present: DataFrame | None = None, of: DataFrame | None = None, made: DataFrame | None = None) -> DataFrame:
    """``s1_idx, pool_idx`` and the stage-1 features of every candidate: 29 of the pair, 5 of its bscore among its rivals, 12 of
    name evidence, and, where the candidates have ``rr``, that score and 5 of its place among its rivals: 52 in all.

    ``present`` (``s1_idx``) names the Source 1 records that are taken to exist: candidates of others are left out before
    rivals and name counts are made, so their pool records become records without a partner. Columns ``rr`` and ``gid``
    are optional. NULL scores stay NULL.

    ``of`` (``s1_idx``) names the Source 1 records whose rows are wanted: the others count as rivals, but get no features.
    ``made``: an earlier table with the rows wanted, for the features that depend on nothing but the pair.
    """
    c = cands if present is None else cands.join(present.select("s1_idx"), "s1_idx", "left_semi")
    reranked = "rr" in c.columns
    c = c.select(*KEYS, "bscore", "n_keys", *(["rr"] if reranked else []))
    context = pairs.group_features(c, "bscore", "b")
    context = pairs.group_features(context, "rr", "r") if reranked else context
    if of is not None:
        c, context = (df.join(of.select("s1_idx"), "s1_idx", "left_semi") for df in (c, context))
    around = context.drop("bscore", "n_keys")
    evidence = pairs.name_evidence(c, s1, pool, None if present is None else present.select(F.col("s1_idx").alias("idx")))
    own = pairs.pair_features(c, s1, pool) if made is None else made.select(*KEYS, *pairs.PAIR_FEATURES)
    return own.join(around, KEYS).join(evidence, KEYS)


def reranked_candidates(s1: DataFrame, pool: DataFrame, settings: Settings, training: DataFrame | None = None, rounds: int = 200) -> DataFrame:
    """``s1_idx, pool_idx, bscore, n_keys, rr``: the ``top_k`` candidates by shared keys, of which the ``rerank_k`` best by a small model stay.

    ``training`` (``s1_idx``): Source 1 records whose pairs the model may see; all by default. ``pool`` has ``gid``.
    """
    wide = cut(blocking.candidates(s1, pool, settings.max_df, settings.top_k))
    known = wide if training is None else wide.join(training.select("s1_idx"), "s1_idx", "left_semi")
    model = scoring.fit(scoring.labelled(pairs.rerank_features(known, s1, pool), pool), scoring.RERANK_FEATURES, rounds)
    return scoring.rerank(wide, s1, pool, model, settings.rerank_k)


def rerank_recall(cands: DataFrame, s1: DataFrame, pool: DataFrame, entities: DataFrame, ks: list[int], rounds: int = 200) -> DataFrame:
    """``k, by_key, by_model``: recall of true pairs among the k best before and after reranking, over the odd ``entities``; the model is fitted on the even ones."""
    known = cands.join(entities.select("s1_idx"), "s1_idx", "left_semi")
    even = F.pmod("s1_idx", F.lit(2)) == 0
    f = cut(scoring.labelled(pairs.rerank_features(known, s1, pool), pool))
    model = scoring.fit(f.where(even), scoring.RERANK_FEATURES, rounds)
    rest = scoring.predict(model, f.where(~even), scoring.RERANK_FEATURES, "rr").select(*KEYS, "bscore", "rr")
    of = pool.join(entities.where(~even).select(F.col("s1_idx").alias("gid")), "gid", "left_semi").select("idx", "gid")
    before, after = (decision.recall_at(rest, of, ks, c).withColumnRenamed("recall", n) for c, n in (("bscore", "by_key"), ("rr", "by_model")))
    return before.join(after, "k")


def sampled_entities(entities: DataFrame, n: int, salt: int = 49) -> DataFrame:
    """``n`` Source 1 records (``s1_idx``), the same whatever the partitions: those of the smallest hash. Fewer than n: all."""
    return entities.select("s1_idx").orderBy(decision.bucket(F.col("s1_idx"), salt, 1 << 31), "s1_idx").limit(n)


@dataclass
class Linker:
    """Both stages' models and the decision rule that was best out of fold."""

    first: scoring.CrossFit
    second: scoring.CrossFit
    rule: dict
    prune: float

    def candidates(self, features: DataFrame) -> DataFrame:
        """``s1_idx, pool_idx, p1, p2`` of records no model has seen: means of both folds' models, pairs from ``prune`` on."""
        p1 = cut(self.first.mean(features, "p1").where(F.col("p1") >= self.prune).select(*KEYS, "p1", *[c for c in scoring.KEPT if c in features.columns]))
        least = p1.agg(F.min("p1").alias("p")).first()["p"]
        if least is not None and least < self.prune:
            raise ValueError(f"a score of {least} is below the bound of {self.prune}")
        return self.second.mean(cut(pairs.stage2_context(p1, "p1")), "p2").select(*KEYS, "p1", "p2")

    def matches(self, scored: DataFrame) -> DataFrame:
        """``s1_idx, pool_idx`` that the rule accepts."""
        return scoring.apply_rule(scored, self.rule, "p2")


def train(features: DataFrame, entities: DataFrame, pool: DataFrame, prune: float = 0.01, rounds: int = 600, sample: float = 1.0, pool_context: bool = True) -> tuple[Linker, DataFrame]:
    """(the linker, its out-of-fold scores ``s1_idx, pool_idx, p1, p2, y, fold``) from the features of labelled ``entities``.

    ``sample``: share of a fold's entities, by hash, that stage 1 is fitted on. ``pool_context``: whether stage 2 sees how
    Source 1 records compete for a pool record. Raises ValueError where the labels are all equal.
    """
    scores, first, second = scoring.two_stage(cut(scoring.labelled(features, pool)), prune, rounds, sample, pool_context)
    scores = cut(scores)
    return Linker(first, second, scoring.best_rule(scores, entities, pool), prune), scores


def evaluate(first: scoring.CrossFit, features: DataFrame, entities: DataFrame, pool: DataFrame, thresholds: tuple[float, ...] = (0.6, 0.7, 0.8, 0.9), prune: float = 0.01) -> DataFrame:
    """Figures of stored stage-1 models on another feature table, out of fold, each pool record given to its best pair: one row a threshold."""
    p1 = first.out_of_fold(scoring.labelled(features, pool), "p1").where(F.col("p1") >= prune).select(*KEYS, "p1")
    return decision.threshold_sweep(cut(p1), entities, pool, list(thresholds), "p1").where("only_best").drop("only_best")


def result_lists(scored: DataFrame, matches: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """One row a Source 1 record: ``source1_entity_id, matched_entity_ids, candidate_entity_ids``."""
    found, seen = id_lists(matches, s1, pool), id_lists(scored, s1, pool, "candidate_entity_ids")
    return found.join(seen, "source1_entity_id")
