"""Every named query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from hashloom import oracle
from hashloom.queries import REGISTRY

from conftest import SMALL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return c


def canon(df):
    cols = sorted(df.columns)
    return df[cols].sort_values(cols).reset_index(drop=True).astype(str)


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_matches_sql(spark, con, name):
    got, want = canon(REGISTRY[name](spark, SMALL).toPandas()), canon(con.sql(oracle.sql(oracle.ORACLES[name])).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert (got == want).all().all()


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(oracle.ORACLES)))
def test_runs(spark, name):
    assert REGISTRY[name](spark, SMALL).count() > 0
