"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from ledgerleaf.plans import catalog
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
        return "null"
    if isinstance(x, (list, np.ndarray)):
        return str([cell(y) for y in x])
    if isinstance(x, (float, np.floating, int, np.integer)) and not isinstance(x, bool):
        return f"{float(x):.9g}"
    return str(x)


def rows(df):
    return sorted("|".join(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE) and len(catalog.QUERIES) > 150


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SMALL).toPandas(), duck.execute(catalog.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
