import numpy as np
from kinmatch.core.session import table
from kinmatch.operators import boosting, pairs, pipeline, scoring
from kinmatch.plans import linkage_queries as q
from test_scoring import features

SF = "/root/testdata/sf0.001"


def test_jobs_do_not_grow_with_the_trees(spark):
    sc = spark.sparkContext
    sc.setJobGroup("boost", "")
    try:
        model = scoring.fit(features(spark), ["bscore", "noise"], rounds=60, valid_share=0.0)
        jobs = sc.statusTracker().getJobIdsForGroup("boost")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(model.leaf) == 60
    assert len(jobs) < 20


def test_the_same_model_whatever_the_number_of_tasks(spark, monkeypatch):
    f = features(spark, 3000)
    one = scoring.fit(f, ["bscore", "noise"], rounds=20)
    monkeypatch.setattr(boosting, "TASK_ROWS", 800)
    monkeypatch.setattr(boosting, "slots", lambda spark: 4)
    spread = scoring.fit(f.repartition(7), ["bscore", "noise"], rounds=20)
    assert one == spread
    p = [r["p"] for r in scoring.predict(one, f.where("y = 1"), ["bscore", "noise"], "p").collect()]
    assert min(p) > 0.5


def test_trees_learn_what_no_single_feature_tells():
    rng = np.random.default_rng(3)
    v = rng.random((4000, 2))
    y = ((v[:, 0] > 0.5) ^ (v[:, 1] > 0.5)).astype(float)
    edges = [np.linspace(0, 1, 63)] * 2
    x = np.stack([np.searchsorted(e, v[:, j]).astype(np.uint8) for j, e in enumerate(edges)])
    valid = np.arange(4000) % 10 == 0
    model = boosting.boost(x, y, valid, np.arange(4000).astype(np.uint64), edges, 0.0, True, 100, 3, 0.1, 42, boosting.Group(1, b""))
    p = model.probability(v)
    assert ((p > 0.5) == (y > 0.5))[valid].mean() > 0.97
    assert boosting.Trees.from_json(model.to_json()) == model


def test_features_of_some_records_equal_those_of_all(spark):
    s1, pool = table(spark, SF, "train_s1").cache(), q._pool(spark, SF).cache()
    c, known = q._given(spark, SF).cache(), q._known(spark, SF).cache()
    every = pipeline.feature_table(c, s1, pool).join(known, "s1_idx", "left_semi").cache()
    some = pipeline.feature_table(c, s1, pool, of=known).cache()
    assert some.columns == every.columns and some.count() == every.count() and some.exceptAll(every).count() == 0
    assert list(pairs.PAIR_FEATURES) == pairs.pair_features(c, s1, pool).columns[2:]
    present = pipeline.sampled_entities(known, 15)
    again = pipeline.feature_table(c, s1, pool, present, made=every)
    new = pipeline.feature_table(c, s1, pool, present)
    assert again.columns == new.columns and again.count() == new.count() and again.exceptAll(new).count() == 0
