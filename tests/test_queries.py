"""Every query of the catalog gives rows, and those its SQL gives."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from loomfield.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v.isoformat(" ")[:19] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    yield con
    con.close()


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) >= 70


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    order = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
    assert got
    if name in SQL:
        cur = duck.execute(SQL[name])
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == order
        at = [columns.index(c) for c in order]
        assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())
