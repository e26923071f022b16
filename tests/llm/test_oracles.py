"""The operators that SQL can express, held against it."""

from __future__ import annotations

import os

import duckdb
import pytest

from millrace.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_operators_match_their_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rounded = lambda rows: sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows)
    assert rounded(df.select(*cols).collect()) == rounded(c.sql(f"select {', '.join(cols)} from ({queries.ORACLE_SQL[name]})").fetchall())
