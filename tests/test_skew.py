from collections import Counter

from kinmatch.operators import skew


def test_eager_join_equals_the_join(spark):
    left = [("a", "n", 1)] * 5 + [("a", "m", 2), ("b", "n", None), (None, "n", 3)]
    right = [("a", "n", 10), ("a", "n", 20), ("b", "n", 5), ("c", "n", 5), (None, "n", 1)]
    sch = "k string, n2 string, v int"
    got = skew.eager_join_rollup(spark.createDataFrame(left, sch), spark.createDataFrame(right, sch), ["k", "n2"], ["k"], ["v"], ["v"]).collect()
    joined = [(x, y) for x in left for y in right if x[0] and x[:2] == y[:2]]
    for r in got:
        mine = [(x, y) for x, y in joined if x[0] == r["k"]]
        assert r["n_joined"] == len(mine)
        assert r["sum_left_v"] == sum(x[2] or 0 for x, _ in mine) and r["sum_right_v"] == sum(y[2] or 0 for _, y in mine)
    assert {r["k"] for r in got} == {x[0] for x, _ in joined}


def test_heavy_keys_and_records(spark):
    rows = [("big", f"n{i % 7}") for i in range(900)] + [(f"k{i}", None) for i in range(95)] + [(None, "x")] * 60
    df = spark.createDataFrame(rows, "k string, name string")
    heavy = {r["k"]: r["n"] for r in skew.heavy_keys(df, "k").collect()}
    assert heavy == {k: n for k, n in Counter(r[0] for r in rows).items() if n > 0.05 * len(rows)}
    per = {r["k"]: tuple(r)[1:] for r in skew.records_per_group(df, "k", "name").collect()}
    assert per["big"] == (900, 7, 129) and per["k1"] == (1, 0, 0)
    assert skew.heavy_keys(df.limit(0), "k").count() == 0
