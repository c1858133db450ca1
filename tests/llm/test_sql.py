"""The registered queries with SQL give DuckDB's rows."""

import duckdb
import pytest

from ridgeline.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries()[name](spark, sf)
    columns = sorted(got.columns)
    assert columns == sorted(con.sql(oracle_sql()[name]).columns)
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, expected))


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in queries()] == list(range(1, 14))
