"""Queries of the subpackage against their SQL."""

import glob
import os

import duckdb
import pytest

from linkloom.llm import queries

from ..conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in df.collect()) == sorted(want.fetchall())
