from kinmatch.llm import visual


def run(spark, rows):
    df = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, clean string, value int")
    return {(r["entity_id"], r["field_name"]): (r["clean"], r["is_case"]) for r in visual.repair_fields(df, "entity_id", ["business_name", "business_address"]).collect()}


def test_cases(spark):
    rows = [
        ("plain", "Bakery Group and Sons CO", "Noël Côte", "x", 1),
        ("wide", "Ｂａｋｅｒｙ", "12 Main Rd", "x", 1),
        ("zero", "Bak​ery", "Mo­tors", "x", 1),
        ("comb", "Café", "a‑b", "x", 1),
        ("lig", "ﬁne oﬃce", "plain", "x", 1),
        ("mixed", "Вakery", "Grοup", "x", 1),
        ("whole", "Zed СО", "", "x", 1),
        ("greek", "Βενκατεσαν ΤΟ", None, "x", 1),
        ("indic", "र्क्‍ष", "  double  blank ", "x", 1),
    ]
    got = run(spark, rows)
    assert got["plain", "business_name"] == ("Bakery Group and Sons CO", False)
    assert got["plain", "business_address"] == ("Noël Côte", False)
    assert got["wide", "business_name"] == ("Bakery", True) and got["wide", "business_address"] == ("12 Main Rd", True)
    assert got["zero", "business_name"] == ("Bakery", True) and got["zero", "business_address"] == ("Motors", True)
    assert got["comb", "business_name"] == ("Café", True) and got["comb", "business_address"] == ("a-b", True)
    assert got["lig", "business_name"] == ("fine office", True)
    assert got["mixed", "business_name"] == ("Bakery", True) and got["mixed", "business_address"] == ("Group", True)
    assert got["whole", "business_name"] == ("Zed CO", True) and got["whole", "business_address"] == ("", False)
    assert got["greek", "business_name"] == ("Βενκατεσαν ΤΟ", False) and got["greek", "business_address"] == (None, False)
    assert got["indic", "business_name"][1] is False and got["indic", "business_address"] == ("  double  blank ", False)


def test_repair_is_idempotent_and_takes_unknown_words(spark):
    got = run(spark, [("a", "Zqхw", "я", "x", 1), ("a", "Zqхw", "я", "x", 1)])
    assert got["a", "business_name"] == ("Zqxw", True)  # no corpus word: the dominant script decides
    assert got["a", "business_address"] == ("я", False)
    for text in ("Café ｘ​", "ﬁ x", "plain"):
        once = visual.plain(text)
        assert visual.plain(once) == once


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_very_long_text():
    text = "Bakery​ " * 50_000
    assert visual.plain(text) == "Bakery " * 50_000
