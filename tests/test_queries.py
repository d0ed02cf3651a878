import glob
import math
import os

import duckdb
import pytest

from textloom.plans import queries as P

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return round(float(v), 6) if isinstance(v, (int, float)) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(P.QUERIES))
def test_query(spark, db, name):
    got = P.QUERIES[name](spark, DATA)
    rows = sorted([tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()], key=str)
    if name in P.ORACLES:
        want = db.sql(P.ORACLES[name])
        names, want = [c for c in want.columns], want.fetchall()
        order = sorted(range(len(names)), key=lambda i: names[i])
        assert sorted(names) == sorted(got.columns)
        assert rows == sorted([tuple(plain(r[i]) for i in order) for r in want], key=str)
