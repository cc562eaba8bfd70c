import math

import pytest
from kinmatch.operators import blocking, decision, pairs
from kinmatch.sources import tables
from pyspark.sql import functions as F

REC = "idx long, country_norm string, name_tok array<string>, addr_tok array<string>"


def test_keys(spark):
    df = spark.createDataFrame([(1, "x", ["b", "a", "b"], ["p", "q", "p", "q"]), (2, "x", [], None), (3, "x", ["a"], ["p"])], REC)
    got = {(r["idx"], r["t"], r["key"]) for r in blocking.record_keys(df).collect()}
    assert got == {(1, "n1", "a"), (1, "n1", "b"), (1, "nn", "a b"), (1, "a1", "p"), (1, "a1", "q"), (1, "ab", "p q"), (1, "ab", "q p"), (3, "n1", "a"), (3, "a1", "p")}


def test_cap_keeps_keys_at_the_cap(spark):
    pool = spark.createDataFrame([(i, "x", ["k2"] if i < 2 else ["k3"], []) for i in range(5)], REC)
    got = {r["key"]: (r["df"], r["idf"]) for r in blocking.key_idf(pool, {"n1": 2}).collect()}
    assert got == {"k2": (2, pytest.approx(math.log(5) - math.log(2)))}


def test_candidates_stay_in_the_country_and_break_ties(spark):
    s1 = spark.createDataFrame([(0, "x", ["a"], []), (1, "y", ["a"], [])], REC)
    pool = spark.createDataFrame([(5, "x", ["a"], []), (4, "x", ["a"], []), (7, "y", ["b"], [])], REC)
    got = [tuple(r)[:2] for r in blocking.candidates(s1, pool, {"n1": 5}, top_k=1).collect()]
    assert got == [(0, 4)]
    empty = blocking.candidates(s1.limit(0), pool, {"n1": 5})
    assert empty.count() == 0


SCORES = "s1_idx long, pool_idx long, p double"


def test_decide_gives_a_pool_record_once(spark):
    s = spark.createDataFrame([(1, 9, 0.8), (2, 9, 0.8), (3, 9, 0.7), (3, 8, 0.4)], SCORES)
    assert {tuple(r) for r in decision.decide(s, 0.5).collect()} == {(1, 9)}
    assert {tuple(r) for r in decision.decide(s, 0.5, only_best=False).collect()} == {(1, 9), (2, 9), (3, 9)}


def expected_by_hand(rows, extra=0.0, min_p=0.05):
    out = set()
    for e in {r[0] for r in rows}:
        all_p = [r for r in rows if r[0] == e]
        use = sorted((r for r in all_p if r[2] >= min_p), key=lambda r: (-r[2], r[1]))
        empty = math.exp(sum(math.log(max(min(1 - r[2], 1), 1e-9)) for r in all_p))
        n = sum(r[2] for r in use) + extra
        best, k = 0, 0
        for i in range(1, len(use) + 1):
            f = round(1.25 * sum(r[2] for r in use[:i]) / (i + 0.25 * n), 12)
            if f > best:
                best, k = f, i
        if best > empty:
            out |= {(e, r[1]) for r in use[:k]}
    return out


def test_expected_f(spark):
    rows = [(1, 1, 0.9), (1, 2, 0.9), (1, 3, 0.2), (2, 4, 0.04), (2, 5, 0.03), (3, 6, 0.5), (4, 7, 0.1), (5, 8, 1.0), (5, 9, 0.6)]
    got = {tuple(r) for r in decision.expected_f(spark.createDataFrame(rows, SCORES)).collect()}
    assert got == expected_by_hand(rows)
    assert not any(e == 2 for e, _ in got)


def test_macro_f(spark):
    pool = spark.createDataFrame([(10, 1), (11, 1), (12, -1), (13, 3)], "idx long, gid long")
    ents = spark.createDataFrame([(1,), (2,), (3,), (4,)], "s1_idx long")
    pred = spark.createDataFrame([(1, 10), (4, 12)], "s1_idx long, pool_idx long")
    r = decision.macro_f(decision.per_entity(pred, ents, pool)).first()
    f1 = 1.25 * 1 * 0.5 / (0.25 * 1 + 0.5)
    assert r["f05"] == pytest.approx((f1 + 1 + 0 + 0) / 4)  # 2: both empty; 3: missed; 4: predicted, nothing true
    assert r["singleton_acc"] == pytest.approx(0.5) and r["n_entities"] == 4
    report = decision.blocking_report(pred, ents, pool).first()
    assert report["pair_recall"] == pytest.approx(1 / 3) and report["s1_zero_cands"] == 2


def test_sweep_equals_single_decisions(spark):
    rows = [(1, 10, 0.9), (2, 10, 0.8), (1, 11, 0.3), (3, 13, 0.5)]
    s = spark.createDataFrame(rows, SCORES)
    pool = spark.createDataFrame([(10, 1), (11, 1), (13, 3)], "idx long, gid long")
    ents = spark.createDataFrame([(1,), (2,), (3,)], "s1_idx long")
    for r in decision.threshold_sweep(s, ents, pool, [0.2, 0.6]).collect():
        one = decision.macro_f(decision.per_entity(decision.decide(s, r["thr"], "p", r["only_best"]), ents, pool)).first()
        assert r["f05"] == pytest.approx(one["f05"])


def test_context_and_ties(spark):
    s = spark.createDataFrame([(1, 9, 0.8), (2, 9, 0.8), (3, 9, 0.1), (3, 8, 0.4)], SCORES)
    got = {(r["s1_idx"], r["pool_idx"]): r for r in pairs.stage2_context(s, "p").collect()}
    assert got[1, 9]["p_best_other_s1"] == 0.8 and got[2, 9]["p_best_other_s1"] == 0.8
    assert got[3, 9]["p_best_other_s1"] == 0.8 and got[3, 8]["p_best_other_s1"] == 0
    assert got[1, 9]["p_rank_pool"] == 1 and got[2, 9]["p_rank_pool"] == 2
    b = {(r["s1_idx"], r["pool_idx"]): r for r in pairs.group_features(s, "p", "b").collect()}
    assert b[3, 8]["b_gap_s1max"] == 0 and b[3, 9]["b_gap_s1max"] == pytest.approx(-0.3) and b[3, 9]["b_n_s1_for_pool"] == 3


def test_tsv_round_trip(spark, tmp_path):
    rows = [('a"b', "", " x "), ("c\\d", "e", "f")]
    df = spark.createDataFrame(rows, "entity_id string, business_name string, country string")
    tables.write_tsv(df.coalesce(1), str(tmp_path / "t"))
    back = tables.read_tsv(spark, str(tmp_path / "t"), df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_labels_lists_and_numbers(spark):
    s1 = spark.createDataFrame([(0, "A"), (1, "B")], "idx long, eid string")
    pool = spark.createDataFrame([(5, "x"), (6, "y"), (7, "z")], "idx long, eid string")
    truth = spark.createDataFrame([("A", "y,x"), ("A", "x,y"), ("B", ""), ("B", None)], "source1_entity_id string, matched_entity_ids string")
    lab = {r["eid"]: r["gid"] for r in tables.label_pool(pool, s1, truth).collect()}
    assert lab == {"x": 0, "y": 0, "z": -1}
    lists = tables.id_lists(spark.createDataFrame([(0, 6), (0, 5), (0, 5), (0, 99)], "s1_idx long, pool_idx long"), s1, pool)
    assert {tuple(r) for r in lists.collect()} == {("A", "x,y"), ("B", "")}
    tables.check_id_lists(lists, s1)
    with pytest.raises(ValueError):
        tables.check_id_lists(lists.limit(1), s1)
    numbered = tables.number_rows(spark.createDataFrame([(f"e{i:03}",) for i in range(50)], "eid string"), ["eid"])
    assert [r["idx"] for r in numbered.orderBy("eid").collect()] == list(range(50))


def test_clashing_column_names(spark):
    from kinmatch.operators import skew

    df = spark.createDataFrame([("x", 1, 2), (None, 1, 2)], "k string, n int, total int")
    assert skew.heavy_keys(df, "k").count() == 2
    c = spark.createDataFrame([(1, 2, 0.5, "z")], "s1_idx long, pool_idx long, p double, r string")
    assert decision.decide(c, 0.1).columns == ["s1_idx", "pool_idx"]


def test_settings_and_json(tmp_path):
    (tmp_path / "s.json").write_text('{"paths": {"work": "w"}, "top_k": 7}')
    s = tables.Settings.load(str(tmp_path / "s.json"))
    assert s.top_k == 7 and (tmp_path / "w").is_dir()
    tables.save_json({"ü": 1}, str(tmp_path / "j"))
    assert tables.load_json(str(tmp_path / "j")) == {"ü": 1} and "ü" in (tmp_path / "j").read_text()


def test_evidence_counts_only_present_entities(spark):
    rec = "idx long, country_norm string, name_norm string, name_tok array<string>"
    s1 = spark.createDataFrame([(0, "x", "a b", ["a", "b"]), (1, "x", "a b", ["a", "b"])], rec)
    pool = spark.createDataFrame([(5, "x", "a c", ["a", "c"]), (6, "x", "", [])], rec)
    prs = spark.createDataFrame([(0, 5), (0, 6)], "s1_idx long, pool_idx long")
    r = {x["pool_idx"]: x for x in pairs.name_evidence(prs, s1, pool).collect()}
    assert r[5]["n_s1_same_name_a"] == 2 and r[5]["leftover_ratio"] == 0
    assert r[6]["shared_idf_sum"] == 0 and r[6]["poolonly_idf_max"] == 0
    p = pairs.name_evidence(prs, s1, pool, present=spark.createDataFrame([(0,)], "idx long")).where(F.col("pool_idx") == 5).first()
    assert p["n_s1_same_name_a"] == 1


def test_whole_candidates_keep_keys_of_the_reference_caps(spark, tmp_path):
    import duckdb

    from kinmatch.plans import catalogue

    schema = "idx bigint, country_norm string, name_tok array<string>, addr_tok array<string>"
    # "often" stands in 400 records, "lots" in 501 and is no key; 400 records share a key, 300 of them are kept.
    pool = [(i, "in", ["often"] if i < 400 else ["lots"], []) for i in range(901)]
    tables_ = {"train_pool": spark.createDataFrame(pool, schema), "train_s1": spark.createDataFrame([(0, "in", ["often", "lots"], [])], schema)}
    con = duckdb.connect()
    for name, df in tables_.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name, n in (("candidates_whole", 300), ("key_df_idf_whole", 1)):
        got = sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect()))
        assert len(got) == n
        assert got == sorted(con.execute(catalogue.SQL[name]).fetchall())
