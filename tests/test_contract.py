"""Every registered query runs, and equals its SQL on the smallest data."""

import decimal
import glob
import os

import duckdb
import pytest

from quorumlake.plans import catalogue


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in cols]).collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        return
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(tuple(map(plain, x)) for x in got) == sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())


def test_entry_without_llm():
    import __spark_entry__ as entry

    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) <= set(entry.queries())
