"""Registered queries against their SQL on the smallest shared tables, where those are."""

import decimal
import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from voxelweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the shared tables aren't here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (not isinstance(v, (str, list, np.ndarray, dict)) and pd.isna(v)):
        return "none"
    return float(v) if isinstance(v, (int, float, np.number, np.bool_, decimal.Decimal)) else str(v)


def rows_of(df):
    """Rows in the order of what is exact (texts, whole numbers) and then of the rest."""
    df = df[sorted(df.columns)]
    rows = [tuple(map(cell, r)) for r in df.itertuples(index=False, name=None)]
    exact = [k for k in range(len(df.columns)) if all(isinstance(r[k], str) or r[k] == int(r[k]) for r in rows if not (isinstance(r[k], float) and not np.isfinite(r[k])))]
    rest = [k for k in range(len(df.columns)) if k not in exact]
    return sorted(rows, key=lambda r: ([str(r[k]) for k in exact], [r[k] if isinstance(r[k], float) else -1e300 for k in rest]))


def same(x, y):
    if isinstance(x, float) and isinstance(y, float):
        return x == y or abs(x - y) <= 2e-5 * max(1, abs(x), abs(y))
    return x == y


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    for a, b in zip(rows_of(got), rows_of(want), strict=True):
        assert all(map(same, a, b)), (a, b)


def test_comparison_tells_numbers_apart():
    assert not same(0.12, 0.98) and not same(-3.1, -3.9) and same(0.1234561, 0.1234562) and not same("none", 0.0)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["region", "voxel_id", "r"]
