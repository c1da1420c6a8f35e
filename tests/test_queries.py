from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from loamdex.queries import registered

NAMES = sorted(registered()[0])


def canon(v):
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return round(v, 5) if v == v else None
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view \"{p.stem}\" as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(canon(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got is not None
        return
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = [tuple(canon(x) for x in row) for row in r.fetchall()]
    order = [names.index(c) for c in cols]
    want = sorted((tuple(row[i] for i in order) for row in want), key=repr)
    number = lambda rows: [tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in row) for row in rows]
    assert sorted(map(repr, number(got))) == sorted(map(repr, number(want)))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
