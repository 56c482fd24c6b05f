"""Queries with SQL agree with DuckDB, on whole tables."""

import duckdb
import pytest

from argentum.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(want.fetchall())
