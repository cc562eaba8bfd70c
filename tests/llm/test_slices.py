"""A search in slices: every document is in one of them, and the result is that of the search in one go."""

import random

from kinmatch.llm import linkage
from pyspark.sql import functions as F


def test_slices_find_what_one_search_finds(spark):
    rng = random.Random(8)
    words = [int(x * x * 60) for x in (rng.random() for _ in range(4000))]
    rows = lambda n: spark.createDataFrame([(i, sorted({rng.choice(words) for _ in range(5)}), [100 + i % 3]) for i in range(n)], "id long, terms array<long>, common array<long>").cache()
    queries, docs = rows(120), rows(200)
    for kw in ({"k": 2, "ties": True, "within": 0.3},):
        whole = {tuple(r) for r in linkage.Index(queries, docs).nearest(**kw).select("q", "d", "rank", F.round("score", 9)).collect()}
        index = linkage.Index(queries, docs, 3)
        sliced = {tuple(r) for r in index.nearest(**kw).select("q", "d", "rank", F.round("score", 9)).collect()}
        assert sliced == whole and whole
    floored = index.queries.withColumn("floor", F.lit(0.0))
    seen = [{r["d"] for r in index.looked_up(floored, F.lit(0), F.size("t"), 200, i).select("d").collect()} for i in range(3)]
    assert all(seen) and len(set.union(*seen)) == sum(map(len, seen))
    index.release()
