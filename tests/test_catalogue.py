"""Every catalogue query against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from seqfold.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    got = catalogue.queries()[name](spark, DATA)
    rows = sorted((tuple(r[c] for c in sorted(got.columns)) for r in got.collect()), key=repr)
    if name in catalogue.oracle_sql():
        want = db.sql(catalogue.oracle_sql()[name])
        names = sorted(want.columns)
        assert names == sorted(got.columns)
        at = [want.columns.index(c) for c in names]
        assert rows == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
