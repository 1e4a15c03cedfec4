"""Each query against its SQL on the smallest tables."""

import math
import os

import pytest

from eluent.plans import catalog

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def shown(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.SQL:
        assert got
        return
    cursor = db.execute(catalog.SQL[name])
    at = [[x[0] for x in cursor.description].index(c) for c in columns]
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in cursor.fetchall())
