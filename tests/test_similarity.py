
import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kinmatch.functions import similarity as sim
from pyspark.sql import functions as F

words = st.text(alphabet="abcd ", max_size=14)


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_ratio_against_dynamic_programming(a, b):
    assert sim.lcs_length(a, b) == lcs(a, b)
    assert sim.ratio(a, b) == sim.ratio(b, a)
    assert 0 <= sim.ratio(a, b) <= 100


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_partial_ratio_against_all_windows(a, b):
    short, long = sorted((a, b), key=len)
    m = len(short)
    if not m:
        return
    sides = [(short, long)] + ([(long, short)] if len(a) == len(b) else [])
    best = max(200 * lcs(s, w) / (m + len(w)) for s, l in sides for k in range(1 - m, len(l)) if (w := l[max(0, k) : k + m]))
    assert sim.partial_ratio(a, b) == pytest.approx(best)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_set_and_sort_ratio(a, b):
    assert 0 <= sim.token_set_ratio(a, b) <= 100
    assert sim.token_set_ratio(a, b) == pytest.approx(sim.token_set_ratio(b, a))
    assert sim.token_sort_ratio(a, " ".join(reversed(a.split()))) == 100


def test_known_values():
    assert sim.ratio("", "") == 100 and sim.ratio("a", "") == 0
    assert sim.token_set_ratio("", "a") == 0
    assert sim.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert sim.token_sort_ratio("new york mets", "mets york new") == 100
    assert sim.partial_ratio("abc", "xxabcyy") == 100
    assert sim.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert sim.jaro_winkler("", "") == 1


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcde", min_size=1, max_size=12), st.text(alphabet="abcde", min_size=1, max_size=12))
def test_jaro_winkler_against_duckdb(a, b):
    want = duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
    assert sim.jaro_winkler(a, b) == pytest.approx(want, abs=1e-9)


def test_udf_has_all_scores_and_takes_nulls(spark):
    df = spark.createDataFrame([("ab", "ab"), (None, "x"), ("", None)], "a string, b string")
    s = sim.similarities({k: (k, F.col("a"), F.col("b")) for k in sim.SCORERS})
    rows = [r["s"] for r in df.select(s.alias("s")).collect()]
    assert set(rows[0].asDict()) == set(sim.SCORERS) and rows[0]["ratio"] == 100
    assert rows[1]["ratio"] == 0 and rows[2]["ratio"] == 100
