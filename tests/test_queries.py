"""Every query of the library against its DuckDB SQL, over the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tessera.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    if v is None or pd.isna(v):
        return "null"
    if isinstance(v, bool):
        return str(int(v))
    return f"{float(v):.9g}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


def rows(pdf):
    return sorted(tuple(map(cell, r)) for r in pdf[sorted(pdf.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF_DIR).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_is_repeatable(spark, name):
    a, b = (catalog.queries()[name](spark, SF_DIR).toPandas() for _ in range(2))
    assert len(a) and rows(a) == rows(b)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) <= set(entry.queries())
