"""Every query with SQL gives DuckDB's rows; the others run; the entry module's three functions agree."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tidewater.plans import catalog


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    out = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in out.fetchall())


def test_entry_functions(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
