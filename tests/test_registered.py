"""Every registered query with SQL gives the rows of its SQL; the others run."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

Q, S = entry.queries(), entry.oracle_sql()
CORE = sorted(k for k in Q if not (k[0] == "p" and k[1].isdigit()))


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5g}"
    if isinstance(v, list):
        return [norm(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_sql_has_queries():
    assert set(S) <= set(Q)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, sf, duck, name):
    t = Q[name](spark, sf).toArrow()
    if name not in S:
        return
    duck.execute(S[name])
    cols = [d[0] for d in duck.description]
    rows = duck.fetchall()
    assert sorted(cols) == sorted(t.column_names)
    o = sorted(cols)
    want = sorted(str([norm(r[cols.index(c)]) for c in o]) for r in rows)
    got = sorted(str([norm(r[c]) for c in o]) for r in t.select(o).to_pylist())
    assert got == want
