"""Every query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from lakesnap.plans import queries as q

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    def plain(v):
        if isinstance(v, float):
            return round(v, 6)
        return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr), sorted(columns)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(q.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    df = q.queries()[name](spark, SF)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("keys", ["range(1000) t(k)", "(SELECT CASE WHEN k < 3 THEN k ELSE 4 * k + 3 END AS k FROM range(1000) t(k))", "(SELECT 4 * k + 1 AS k FROM range(9) t(k) UNION ALL SELECT NULL)", "(SELECT 1 AS k WHERE false)"])
def test_copies_are_counted_however_keys_are_spread(spark, tmp_path, keys):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE supplier AS SELECT k::BIGINT AS s_suppkey, 'x' AS s_name FROM {keys}")
    con.execute(f"COPY supplier TO '{tmp_path}/supplier.parquet'")
    want = con.execute(q.oracle_sql()["copy_outcome_policy"]).fetchall()
    assert [tuple(r) for r in q.queries()["copy_outcome_policy"](spark, str(tmp_path)).collect()] == want
