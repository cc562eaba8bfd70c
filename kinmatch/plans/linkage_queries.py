"""Queries of the record-linkage operators over the business tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.core.session import cut, table
from kinmatch.functions import text
from kinmatch.functions.similarity import similarities
from kinmatch.operators import blocking, decision, normalize, pairs, pipeline, scoring
from kinmatch.sources import tables

#: Document frequency cap of every key kind, and candidates per record, of the queries over the small tables. The whole job
#: (``key_df_idf_whole``, ``candidates_whole``) takes both from ``tables.Settings``: 500 and 300, as the reference.
CAPS = {k: 50 for k in blocking.KINDS}
TOP_K = 20
KS = [5, 10, 20, 50, 100]
GRID = [round(0.05 * i, 2) for i in range(4, 20)]


def _s1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train_s1")


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return tables.label_pool(table(spark, d, "train_pool"), _s1(spark, d), table(spark, d, "train_matches"))


def _cands(spark: SparkSession, d: str) -> DataFrame:
    """Scored pairs, each once with its highest score, and a probability-like p from it."""
    c = table(spark, d, "candidates").where("bscore is not null and not isnan(bscore)")
    best = c.groupBy("s1_idx", "pool_idx").agg(F.max("bscore").alias("bscore"), F.max("n_keys").alias("n_keys"))
    return best.withColumn("p", F.round(F.col("bscore") / (F.col("bscore") + 20.0), 6))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return _s1(spark, d).select(F.col("idx").alias("s1_idx"))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def source_records(spark: SparkSession, d: str) -> DataFrame:
    """Sources 2 and 3 as one pool with a source mark."""
    parts = [tables.source_records(table(spark, d, f"train_source{k}"), k) for k in (2, 3)]
    return tables.pooled(*parts).distinct()


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned sample sentences and evaluation items."""
    rows = table(spark, d, "lang_samples").select(F.col("sample_id").alias("id"), "text").unionByName(table(spark, d, "eval_items").select(F.col("item_id").alias("id"), "text"))
    return rows.select("id", text.clean(F.col("text")).alias("cleaned"))


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    """Words of the sample sentences with their places."""
    return table(spark, d, "lang_samples").select("sample_id", F.posexplode(text.tokens(text.clean(F.col("text")))).alias("place", "token"))


def _normalized(spark: SparkSession, d: str, name: str) -> DataFrame:
    raw = table(spark, d, name).select("idx", "name", "addr", "country")
    return normalize.add_normalized(normalize.raw_tokens(raw)).select("idx", "name_norm", "addr_norm", "country_norm", "name_deva")


def normalize_s1(spark: SparkSession, d: str) -> DataFrame:
    """Normalized columns of Source 1, made from the raw text."""
    return _normalized(spark, d, "train_s1")


def normalize_pool(spark: SparkSession, d: str) -> DataFrame:
    """Normalized columns of the pool, made from the raw text."""
    return _normalized(spark, d, "train_pool")


def abbrev_expand(spark: SparkSession, d: str) -> DataFrame:
    """How often every spelled-out address word occurs in the pool."""
    toks = normalize.add_normalized(normalize.raw_tokens(table(spark, d, "train_pool").select("idx", "name", "addr", "country")))
    return toks.select(F.explode("addr_tok").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def name_deva_flag(spark: SparkSession, d: str) -> DataFrame:
    """Records with an Indic name, per source."""
    return table(spark, d, "train_pool").groupBy("src").agg(F.count_if(text.is_indic(F.col("name"))).alias("n_indic"), F.count(F.lit(1)).alias("n"))


def numeric_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of every pool address."""
    return table(spark, d, "train_pool").select("idx", F.array_join(text.numbers(F.col("addr_tok")), " ").alias("numbers"))


def block_keys(spark: SparkSession, d: str) -> DataFrame:
    """Blocking keys of Source 1."""
    return blocking.record_keys(_s1(spark, d)).select("idx", "t", "key")


def key_df_idf(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and idf of the pool's rare keys."""
    return _rounded(blocking.key_idf(table(spark, d, "train_pool"), CAPS))


def candidates_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best pool records of every Source 1 record by shared rare keys."""
    return _rounded(blocking.candidates(_s1(spark, d), table(spark, d, "train_pool"), CAPS, TOP_K))


def key_df_idf_whole(spark: SparkSession, d: str) -> DataFrame:
    """``key_df_idf`` under the reference's caps."""
    return _rounded(blocking.key_idf(table(spark, d, "train_pool"), tables.Settings().max_df))


def candidates_whole(spark: SparkSession, d: str) -> DataFrame:
    """``candidates_topk`` with the reference's caps and number of candidates."""
    settings = tables.Settings()
    return _rounded(blocking.candidates(_s1(spark, d), table(spark, d, "train_pool"), settings.max_df, settings.top_k))


def candidate_context(spark: SparkSession, d: str) -> DataFrame:
    """Ranks and gaps of every candidate score on both sides."""
    return _rounded(pairs.group_features(_cands(spark, d).select("s1_idx", "pool_idx", "bscore")))


def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Set, length and flag features of every candidate pair."""
    joined = pairs.attach(_cands(spark, d).select("s1_idx", "pool_idx"), pairs.side(_s1(spark, d)), pairs.side(table(spark, d, "train_pool")))
    return _rounded(joined.select("s1_idx", "pool_idx", *[v.alias(k) for k, v in pairs.set_features(joined).items()]))


def name_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    """How many records of both sides bear every Source 1 record's name."""
    return pairs.name_counts(_s1(spark, d), table(spark, d, "train_pool"))[0].select("idx", "n_s1_same_name", "n_pool_same_name")


def token_idf(spark: SparkSession, d: str) -> DataFrame:
    """idf of every name word by country."""
    return _rounded(pairs.token_idf(_s1(spark, d), table(spark, d, "train_pool")))


def name_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Weight of shared and unshared name words of every candidate pair."""
    return _rounded(pairs.name_evidence(_cands(spark, d), _s1(spark, d), table(spark, d, "train_pool")).drop("leftover_ratio"))


def leftover_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of the unshared name words of every candidate pair."""
    return _rounded(pairs.name_evidence(_cands(spark, d), _s1(spark, d), table(spark, d, "train_pool")).select("s1_idx", "pool_idx", "leftover_ratio"))


def sim_jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    """Jaro-Winkler similarity of the names of every candidate pair that has both."""
    j = pairs.attach(_cands(spark, d).select("s1_idx", "pool_idx"), _s1(spark, d), table(spark, d, "train_pool"), ["name_norm"]).where("name_norm_a <> '' and name_norm_b <> ''")
    return _rounded(j.select("s1_idx", "pool_idx", similarities({"jw": ("jaro_winkler", F.col("name_norm_a"), F.col("name_norm_b"))}).alias("s")).select("s1_idx", "pool_idx", "s.jw"))


def pair_features(spark: SparkSession, d: str) -> DataFrame:
    """All 29 first-stage features of every candidate pair."""
    return _rounded(pairs.pair_features(_cands(spark, d), _s1(spark, d), table(spark, d, "train_pool")))


def stage2_context(spark: SparkSession, d: str) -> DataFrame:
    """Competition features of a score."""
    return _rounded(pairs.stage2_context(_cands(spark, d).select("s1_idx", "pool_idx", "p"), "p"))


def decide_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Pairs from a threshold on."""
    return decision.decide(_cands(spark, d), 0.6, "p", False)


def decide_exclusive(spark: SparkSession, d: str) -> DataFrame:
    """Pairs from a threshold on, each pool record once."""
    return decision.decide(_cands(spark, d), 0.6, "p", True)


def expected_f(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the best expected F."""
    return decision.expected_f(decision.exclusive(_cands(spark, d), "p"), "p")


def macro_f05(spark: SparkSession, d: str) -> DataFrame:
    """Macro F 0.5 of the exclusive threshold decision."""
    pred = decision.decide(_cands(spark, d), 0.6, "p", True)
    return _rounded(decision.macro_f(decision.per_entity(pred, _entities(spark, d), _pool(spark, d))))


def blocking_report(spark: SparkSession, d: str) -> DataFrame:
    """Recall and size of the candidates."""
    return _rounded(decision.blocking_report(_cands(spark, d), _entities(spark, d), _pool(spark, d)))


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Recall among the k best candidates."""
    return _rounded(decision.recall_at(_cands(spark, d), _pool(spark, d), KS))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Macro F 0.5 of sixteen thresholds with and without exclusiveness."""
    return _rounded(decision.threshold_sweep(_cands(spark, d), _entities(spark, d), _pool(spark, d), GRID).select("thr", "only_best", "f05", "pair_precision", "pair_recall"))


def label_join(spark: SparkSession, d: str) -> DataFrame:
    """Pool records with the Source 1 record that the truth links them to."""
    return _pool(spark, d).select("idx", "eid", "gid")


def semi_truth(spark: SparkSession, d: str) -> DataFrame:
    """Pool records that belong to one of the candidates' Source 1 records."""
    return _pool(spark, d).join(_cands(spark, d).select(F.col("s1_idx").alias("gid")).distinct(), "gid", "left_semi").select("idx", "gid")


def hash_fold(spark: SparkSession, d: str) -> DataFrame:
    """Fold of every Source 1 record by a hash of its id."""
    return _s1(spark, d).select("idx", decision.bucket(F.col("eid"), 42, 2).alias("fold"), decision.bucket(F.col("eid"), 5, 1000).alias("bucket"))


def absent_entities(spark: SparkSession, d: str) -> DataFrame:
    """Context features where a hashed fifth of the Source 1 records is taken away before they are made."""
    present = decision.subset(_entities(spark, d), "s1_idx", 0.81)
    return _rounded(pairs.group_features(_cands(spark, d).join(present, "s1_idx", "left_semi").select("s1_idx", "pool_idx", "bscore")))


def translit_learn(spark: SparkSession, d: str) -> DataFrame:
    """Latin spellings of Indic words, learned from labelled pairs."""
    return normalize.learn_dictionary(_s1(spark, d), _pool(spark, d))


def translit_apply(spark: SparkSession, d: str) -> DataFrame:
    """Pool names with Indic words replaced by learned or romanized spellings."""
    raw = normalize.raw_tokens(table(spark, d, "train_pool").select("idx", "name", "addr", "country"))
    words = cut(normalize.indic_words(raw, translit_learn(spark, d)))
    return normalize.add_normalized(raw, words).select("idx", "name_norm", "addr_norm", "name_deva")


def id_lists(spark: SparkSession, d: str) -> DataFrame:
    """One row per Source 1 record with its accepted pool ids."""
    return tables.id_lists(decide_exclusive(spark, d), _s1(spark, d), table(spark, d, "train_pool"))


def _similarity(spark: SparkSession, d: str, scorer: str) -> DataFrame:
    j = pairs.attach(_cands(spark, d).select("s1_idx", "pool_idx"), _s1(spark, d), table(spark, d, "train_pool"), ["name_norm"]).where("name_norm_a <> '' and name_norm_b <> ''")
    score = similarities({"score": (scorer, F.col("name_norm_a"), F.col("name_norm_b"))})
    return _rounded(j.select("s1_idx", "pool_idx", score.alias("s")).select("s1_idx", "pool_idx", "s.score"))


def sim_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Common subsequence ratio of the names of every candidate pair that has both."""
    return _similarity(spark, d, "ratio")


def sim_token_sort(spark: SparkSession, d: str) -> DataFrame:
    """The same of the words in sorted order."""
    return _similarity(spark, d, "token_sort")


def sim_token_set(spark: SparkSession, d: str) -> DataFrame:
    """The same of the word sets."""
    return _similarity(spark, d, "token_set")


def sim_partial(spark: SparkSession, d: str) -> DataFrame:
    """The same of the shorter name and the best stretch of the longer one."""
    return _similarity(spark, d, "partial")


def _known(spark: SparkSession, d: str) -> DataFrame:
    """Source 1 records whose partners are known."""
    labels = table(spark, d, "train_matches").select(F.col("source1_entity_id").alias("eid")).distinct()
    return _s1(spark, d).join(labels, "eid", "left_semi").select(F.col("idx").alias("s1_idx"))


def rerank(spark: SparkSession, d: str) -> DataFrame:
    """Candidates scored again by a small model of the labelled Source 1 records, the fifty best of every record."""
    s1, pool = _s1(spark, d), cut(_pool(spark, d))
    c = cut(_cands(spark, d).drop("p"))
    model = scoring.train_reranker(c.join(_known(spark, d), "s1_idx", "left_semi"), s1, pool)
    return scoring.rerank(c, s1, pool, model, tables.Settings().rerank_k)


def rerank_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the labelled records' true pairs before and after reranking."""
    return _rounded(pipeline.rerank_recall(cut(_cands(spark, d).drop("p")), _s1(spark, d), cut(_pool(spark, d)), _known(spark, d), [5, 10, 20, 50]))


def _given(spark: SparkSession, d: str) -> DataFrame:
    """The candidates as given, with ``rr``, every pair once."""
    given = table(spark, d, "candidates").where("bscore is not null and not isnan(bscore)")
    return given.groupBy("s1_idx", "pool_idx").agg(F.max("bscore").alias("bscore"), F.max("n_keys").alias("n_keys"), F.max("rr").alias("rr"))


def _trained(spark: SparkSession, d: str, unlabelled: bool = False) -> tuple[pipeline.Linker, DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(linker, its out-of-fold scores, features of the labelled records' candidates or of all, Source 1, pool, labelled records)."""
    s1, pool, known = _s1(spark, d), cut(_pool(spark, d)), cut(_known(spark, d))
    features = cut(pipeline.feature_table(_given(spark, d), s1, pool, of=None if unlabelled else known))
    linker, scores = pipeline.train(features.join(known, "s1_idx", "left_semi"), known, pool)
    return linker, scores, features, s1, pool, known


def pair_model(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold probabilities of both stages for the labelled Source 1 records' candidates."""
    return _trained(spark, d)[1]


def model_quality(spark: SparkSession, d: str) -> DataFrame:
    """Macro F 0.5 of both stages out of fold, by threshold, and of the stored stage-1 models where a hashed fifth of the records is absent."""
    linker, scores, features, s1, pool, known = _trained(spark, d)
    grid = [0.6, 0.7, 0.8, 0.9]
    rows = [decision.threshold_sweep(scores, known, pool, grid, p).where("only_best").withColumn("stage", F.lit(p)) for p in ("p1", "p2")]
    present = decision.subset(known, "s1_idx", 0.81)
    rows.append(pipeline.evaluate(linker.first, pipeline.feature_table(_given(spark, d), s1, pool, present, made=features), present, pool).withColumns({"only_best": F.lit(True), "stage": F.lit("p1 of present records")}))
    return _rounded(rows[0].unionByName(rows[1]).unionByName(rows[2]).drop("only_best"))


def linkage_run(spark: SparkSession, d: str) -> DataFrame:
    """Matches and candidates of every Source 1 record whose partners are not known, as lists of ids."""
    linker, _, features, s1, pool, known = _trained(spark, d, unlabelled=True)
    scored = cut(linker.candidates(features.join(known, "s1_idx", "left_anti")))
    unknown = s1.join(known.select(F.col("s1_idx").alias("idx")), "idx", "left_anti")
    return pipeline.result_lists(scored, linker.matches(scored), unknown, pool)


QUERIES = {
    f.__name__: f
    for f in (
        candidates_topk, source_records, clean_text, tokenize, normalize_s1, normalize_pool, abbrev_expand, name_deva_flag, numeric_tokens, block_keys, key_df_idf, key_df_idf_whole, candidates_whole, candidate_context, token_jaccard,
        name_ambiguity, token_idf, name_evidence, leftover_similarity, sim_jaro_winkler, sim_ratio, sim_token_sort, sim_token_set, sim_partial, pair_features, stage2_context, decide_threshold, decide_exclusive, expected_f, macro_f05, blocking_report,
        recall_at_k, threshold_sweep, label_join, semi_truth, hash_fold, absent_entities, translit_learn, translit_apply, id_lists, rerank, rerank_recall, pair_model, model_quality, linkage_run,
    )
}
