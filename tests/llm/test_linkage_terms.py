"""Which records of two sources meet."""

from kinmatch.llm import linkage


def test_records_meet_by_words_alone(spark):
    # Trade and town are known on the pool's side and differ from, or lack on, the other: only the words are in common.
    rows = [("a", True, "Zorvelix Quandor", "12 Oak Street, Springfield 62704", "US"), ("b", False, "Quandor Zorvelix Motors", "7 Rovepe Road, Alnagar, 111001", "India")]
    rows += [("c", False, "Quandor Motors", "Alnagar, 111001", "India"), ("d", False, "Pemilora Motors", "Alnagar, 111001", "India")]
    rows += [(f"x{i}", False, f"Bomasu{'abcdefgh'[i]} Motors", f"{i + 1} Rovepe Road, Alnagar, 11100{i}", "India") for i in range(6)]
    df = spark.createDataFrame(rows, "id string, primary boolean, business_name string, business_address string, country string")
    both = linkage.attributes(df).select("id", "primary", "terms", "common")
    a = both.where("primary").drop("primary")
    pool = both.where("not primary").drop("primary")
    forth = {r["q"] for r in linkage.nearest(pool, a, 2, ties=True, least=0.0).collect()}
    assert {"b", "c"} <= forth and "d" not in forth
    assert {r["d"] for r in linkage.nearest(a, pool, 3, least=0.0).collect()} == {"b", "c"}
