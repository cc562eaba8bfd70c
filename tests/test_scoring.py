import random

import pytest
from kinmatch.operators import blocking, scoring
from kinmatch.streaming import scoring as stream


def features(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.random() < 0.3
        rows.append((i // 3, i, float(y) * 0.8 + rng.random() * 0.4, rng.random(), int(y), (i // 3) % 2))
    return spark.createDataFrame(rows, "s1_idx long, pool_idx long, bscore double, noise double, y int, fold int")


def test_cross_fit_scores_out_of_fold_and_models_survive_disk(spark, tmp_path):
    f = features(spark)
    cols = scoring.feature_columns(f)
    assert cols == ["bscore", "noise"]
    assert scoring.feature_columns(f, ("noi",)) == ["bscore"]
    scores, first, second = scoring.two_stage(f, rounds=3)
    rows = scores.collect()
    good = [r["p2"] for r in rows if r["y"] == 1]
    bad = [r["p2"] for r in rows if r["y"] == 0]
    assert sum(good) / len(good) > sum(bad) / len(bad) + 0.4
    assert all(r["p1"] >= 0.01 for r in rows)
    path = str(tmp_path / "m")
    scoring.save_model(first.models[0], path)
    again = scoring.load_model(path)
    a = [r["p"] for r in scoring.predict(first.models[0], f, cols, "p").orderBy("pool_idx").collect()]
    b = [r["p"] for r in scoring.predict(again, f, cols, "p").orderBy("pool_idx").collect()]
    assert a == b
    mean = first.mean(f.limit(5), "p").collect()
    assert all(0 <= r["p"] <= 1 for r in mean)
    pool = f.where("y = 1").selectExpr("pool_idx AS idx", "s1_idx AS gid").unionByName(f.where("y = 0").selectExpr("pool_idx AS idx", "-1L AS gid"))
    rule = scoring.best_rule(scores, f.select("s1_idx").distinct(), pool)
    assert rule["f05"] > 0.8
    assert scoring.apply_rule(scores, rule).columns == ["s1_idx", "pool_idx"]


def test_one_label_is_an_error(spark):
    with pytest.raises(ValueError):
        scoring.fit(features(spark).where("y = 1"), ["bscore"])


def test_rerank(spark):
    rec = "idx long, name_norm string, addr_norm string, gid long"
    s1 = spark.createDataFrame([(i, f"name{i} bakery", f"{i} main road", 0) for i in range(60)], rec).drop("gid")
    pool = spark.createDataFrame([(100 + i, f"name{i} bakery", f"{i} main road", i) for i in range(60)], rec)
    c = spark.createDataFrame([(i, 100 + (i + k) % 60, 1.0 + k / 10, 2) for i in range(60) for k in range(3)], "s1_idx long, pool_idx long, bscore double, n_keys long")
    model = scoring.train_reranker(c, s1, pool, rounds=3)
    got = scoring.rerank(c, s1, pool, model, 1).collect()
    assert len(got) == 60 and sum(r["pool_idx"] == 100 + r["s1_idx"] for r in got) >= 55


def test_stream_equals_batch(spark, tmp_path):
    rec = "idx long, country_norm string, name_tok array<string>, addr_tok array<string>"
    s1 = spark.createDataFrame([(i, "x", [f"w{i}", "bakery"], []) for i in range(5)], rec)
    new = spark.createDataFrame([(50 + i, "x", [f"w{i}"], []) for i in range(3)], rec)
    new.write.parquet(str(tmp_path / "in"))
    caps = {"n1": 3, "nn": 3}
    q = stream.stream_candidates(spark, str(tmp_path / "in"), new.schema, stream.s1_index(s1, caps), caps, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {(r["s1_idx"], r["pool_idx"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["s1_idx"], r["pool_idx"]) for r in blocking.candidates(new, s1, caps).selectExpr("pool_idx AS s1_idx", "s1_idx AS pool_idx").collect()}
    assert got == want == {(i, 50 + i) for i in range(3)}
