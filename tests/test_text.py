import unicodedata

from kinmatch.functions import text
from kinmatch.operators import normalize
from pyspark.sql import functions as F


def cleaned(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["c"] for r in df.select("i", text.clean(F.col("v")).alias("c")).orderBy("i").collect()]


def test_clean_cases(spark):
    got = cleaned(spark, ["<NULL> Road", "null", "N/A", "annul", "A&B", "Épicerie  Bât.", "-- X", "", None, "Ｆｕｌｌ ﬁne", "क़ीमत"])
    assert got[:10] == ["road", "", "", "annul", "a and b", "epicerie bat", "x", "", "", "full fine"]
    assert got[10] == unicodedata.normalize("NFKD", "क़ीमत")


def test_clean_agrees_with_unicode_normalization(spark):
    import re

    chars = [chr(c) for c in [*range(0xA0, 0x250), *range(0x900, 0xE00), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), 0x2460, 0x210B, 0x1D400]]
    chars = [c for c in chars if unicodedata.category(c) != "Cn"]

    def by_hand(v):
        v = unicodedata.normalize("NFKD", v.lower())
        v = re.sub("[̀-ͯ]", "", v).replace("&", " and ")
        return re.sub("[^a-z0-9ऀ-෿]+", " ", v).strip()

    got = cleaned(spark, [f"x{c}y" for c in chars])
    wrong = [(c, g) for c, g in zip(chars, got) if g != by_hand(f"x{c}y")]
    assert not wrong


def test_romanize():
    assert text.romanize_word("राम") == "ram"
    assert text.romanize_word("कमल") == "kamal"
    assert text.romanize_word("हिन्दी") == "hindee"
    assert text.romanize_word("abc") == "abc"
    assert text.romanize_word("") == ""


def test_abbreviations_depend_on_the_field(spark):
    df = spark.createDataFrame([(1, "R S Co", "12 r Co st", "India")], "idx int, name string, addr string, country string")
    r = normalize.add_normalized(normalize.raw_tokens(df)).first()
    assert r["name_norm"] == "r s company"
    assert r["addr_norm"] == "12 rue co street"
    assert r["country_norm"] == "india" and r["name_deva"] is False


def test_null_text(spark):
    df = spark.createDataFrame([(1, None, None, None)], "idx int, name string, addr string, country string")
    r = normalize.add_normalized(normalize.raw_tokens(df)).first()
    assert r["name_tok"] == [] and r["addr_norm"] == "" and r["country_norm"] == "" and r["name_deva"] is False


def test_learn_and_apply_dictionary(spark):
    s1 = spark.createDataFrame([(i, ["ram", "stores"], ["main", "road", f"x{i}"]) for i in range(4)], "idx long, name_tok array<string>, addr_tok array<string>")
    pool = spark.createDataFrame([(10 + i, i, ["राम", "stores"], ["रोड", "12"]) for i in range(4)] + [(99, -1, ["राम"], [])], "idx long, gid long, name_tok array<string>, addr_tok array<string>")
    learned = {r["src_tok"]: r["dst_tok"] for r in normalize.learn_dictionary(s1, pool).collect()}
    assert learned == {"राम": "ram", "रोड": "main"}  # main and road are tied: the first in order
    raw = spark.createDataFrame([(1, ["राम", "कमल", "ತ"], ["रोड"], "", "राम", "")], "idx int, name_tok array<string>, addr_tok array<string>, addr string, name string, country string")
    words = normalize.indic_words(raw, spark.createDataFrame(list(learned.items()), "src_tok string, dst_tok string"))
    r = normalize.add_normalized(raw, words).first()
    assert r["name_norm"] == "ram kamal ತ" and r["addr_norm"] == "main"
