"""Every query of the library against its SQL twin."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from orbitframe.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or v is np.ma.masked or isinstance(v, float) and np.isnan(v):
        return None
    if isinstance(v, (list, np.ndarray)):
        return str([plain(x) for x in v])
    return repr(round(float(v), 5)) if isinstance(v, (float, int, np.number)) and not isinstance(v, bool) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "embeddings", "lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    ours, theirs = registry.queries()[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
