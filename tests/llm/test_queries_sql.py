from pathlib import Path

import duckdb
import pytest

from loamdex.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view \"{p.stem}\" as select * from '{p}'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({SQL[name]})").fetchall()
    assert sorted(want) == sorted(tuple(r[c] for c in cols) for r in df.collect())
