from pathlib import Path

import __spark_entry__ as entry
import duckdb
import pandas as pd
import pytest

from kinmatch.plans import catalogue

DATA = "/root/testdata/sf0.001"


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    text = pd.DataFrame({c: df[c].map(lambda v: "" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)) for c in df.columns})
    return text.sort_values(list(text.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*' if p.is_dir() else ''}'")
    return con


def test_names_of_queries_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["candidates_topk", "p5_found", "macro_f05", "normalize_s1"])
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() >= 1


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = normal(catalogue.QUERIES[name](spark, DATA).toPandas()), normal(duck.execute(catalogue.SQL[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)
