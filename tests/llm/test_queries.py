"""The text queries that have SQL against DuckDB, and the entry module."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from panelnet.llm import oracles, queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(oracles.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(D):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    want = con.sql(oracles.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, D).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    want, got = (x[cols].sort_values(cols).reset_index(drop=True).astype(str) for x in (want, got))
    assert got.equals(want)


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(oracles.ORACLES) <= set(entry.oracle_sql())
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
