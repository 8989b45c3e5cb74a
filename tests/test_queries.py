"""Every registered query with SQL gives the rows that DuckDB gives for it on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from tessera.plans import registered as plans

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{D}/{f}')")
    return c


def norm(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(norm, x))
    if x is None or (isinstance(x, float) and x != x):
        return None
    if hasattr(x, "isoformat"):
        return str(x)[:26]
    if isinstance(x, (float, np.floating)):
        return round(float(x), 7) + 0.0
    return int(x) if isinstance(x, (int, np.integer)) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(spark, con, name):
    got, want = plans.QUERIES[name](spark, D).toPandas(), con.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda f: sorted((tuple(map(norm, r)) for r in f[sorted(f.columns)].itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, D).count() > 0
