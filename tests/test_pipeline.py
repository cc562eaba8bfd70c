"""The chain from candidates to lists of ids."""

from kinmatch.core.session import table
from kinmatch.operators import pipeline, scoring
from kinmatch.plans import linkage_queries as q

SF = "/root/testdata/sf0.001"


def test_chain(spark):
    s1, pool = table(spark, SF, "train_s1").cache(), q._pool(spark, SF).cache()
    c = q._cands(spark, SF).drop("p").withColumn("rr", q.F.col("bscore") / 100)
    f = pipeline.feature_table(c, s1, pool).cache()
    assert len(scoring.feature_columns(f)) == 52 and f.count() == c.count()
    assert len(scoring.feature_columns(pipeline.feature_table(c.drop("rr"), s1, pool))) == 46
    known = q._known(spark, SF).cache()
    linker, scores = pipeline.train(f.join(known, "s1_idx", "left_semi"), known, pool, rounds=5)
    assert scores.columns == ["s1_idx", "pool_idx", "p1", "p2", "y", "fold"]
    assert len(linker.second.columns) == 22
    seen = linker.candidates(f).cache()
    assert seen.where("p1 < 0.01").count() == 0
    lists = pipeline.result_lists(seen, linker.matches(seen), s1, pool).collect()
    assert len(lists) == s1.count() and any(r["matched_entity_ids"] for r in lists)
    assert all(set(filter(None, r["matched_entity_ids"].split(","))) <= set(r["candidate_entity_ids"].split(",")) for r in lists)
    present = pipeline.sampled_entities(known, 20)
    assert present.count() == 20
    assert {r["thr"] for r in pipeline.evaluate(linker.first, pipeline.feature_table(c, s1, pool, present), present, pool).collect()} == {0.6, 0.7, 0.8, 0.9}
    none = pipeline.feature_table(c.limit(0), s1, pool)
    assert none.count() == 0 and set(none.columns) == set(f.columns)
