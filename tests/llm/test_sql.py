"""Queries with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from lakesnap.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(q.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    df = q.queries()[name](spark, SF)
    assert df.columns == columns
    assert sorted(tuple(r) for r in df.collect()) == sorted(want.fetchall())
