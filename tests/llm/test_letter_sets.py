"""The cheap comparison before all others drops no pair that the rule accepts."""

import random

from pyspark.sql import functions as F

from kinmatch.llm import names
from kinmatch.llm.same_names import letter_sets, letters_agree, parse_names


def test_letters_agree_is_a_bound_of_the_rule(spark):
    r = random.Random(5)
    words = ["martha", "marhta", "dwayne", "duane", "bakofimol", "bakofmiol", "bob", "robert", "liz", "elizabeth", "tado", "tadowelimoner", "tadowelmioner", "jo", "johannes", "yofimol", "rolunem", "gayave"]

    def spoilt(w):
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("aeknrst") + w[i:], w[: i - 1] + w[i : i + 1] + w[i - 1 : i] + w[i + 1 :] if i else w, w[:i] + r.choice("aeknrst") + w[i + 1 :]]) or w
        return w

    texts = set()
    for _ in range(420):
        own = [spoilt(w) for w in r.sample(words, r.choice((1, 2, 2, 3, 4)))]
        own = [w[:4] + "." if r.random() < 0.05 else w for w in own]
        texts.add(r.choice(("", "", " ")).join(own) if r.random() < 0.1 else " ".join(own) + r.choice(("", " Motors", " Bakery")))
    texts |= {"यफिजुम रोलुनेम Motors", "Yafijum Rolunem Motors", "Yofimol Rolunem Motors", "Yofimolrolunem Motors"}
    parsed = {t: n for t in sorted(texts) if (n := names.parse(t))}
    df = letter_sets(spark.createDataFrame([(t,) for t in parsed], "t string").select("t", parse_names("t").alias("n")).select("t", "n.*")).select("t", "ls")
    a, b = df.select(F.col("t").alias("x"), F.col("ls").alias("a")), df.select(F.col("t").alias("y"), F.col("ls").alias("b"))
    kept = {(p["x"], p["y"]) for p in a.crossJoin(b).where("x < y").where(letters_agree(F.col("a"), F.col("b"))).select("x", "y").collect()}
    every = [(x, y) for x in parsed for y in parsed if x < y]
    right = {p for p in every if names.same_name(parsed[p[0]], parsed[p[1]])}
    assert len(right) > 50 and right <= kept
    assert len(kept) < 0.8 * len(every)
