"""Every panel query that has SQL against DuckDB, on the smallest tables; the others give rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from panelnet.plans import queries as q

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", list(q.ORACLES))
def test_sql(spark, con, name):
    want, got = con.sql(q.ORACLES[name]).df(), q.QUERIES[name](spark, D).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert [str(want[c].dtype) for c in cols] == [str(got[c].dtype) for c in cols]
    want, got = (x[cols].sort_values(cols).reset_index(drop=True).astype(str) for x in (want, got))
    assert got.equals(want)


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n not in q.ORACLES])
def test_rows(spark, name):
    assert q.QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
