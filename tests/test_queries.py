"""Every query of the library against its SQL on the smallest tables; those without SQL run and give rows."""

import glob
import os

import duckdb
import pytest

from linkloom.plans import registry

from .conftest import DATA

SLOW = {"g19b_neighbour_map", "g20_simulation", "g19_projection", "g10_louvain", "g11_core_numbers", "g11b_backbone", "g8c_weighted_path", "g18_embedding", "t20_text_classifier", "g14_force_layout", "g15_pinned_layout"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    return (2, f"{float(v):.9g}") if isinstance(v, int | float) else (3, str(v))


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in SLOW])
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in registry.oracle_sql():
        r = con.sql(registry.oracle_sql()[name])
        assert sorted(r.columns) == cols
        at = [r.columns.index(c) for c in cols]
        assert rows == sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())
    else:
        assert rows
