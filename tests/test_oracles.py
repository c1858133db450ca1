"""Every registered query with SQL gives DuckDB's rows; the rows of the others don't depend on how they are dealt."""

import math

import duckdb
import pytest

from ridgeline.plans import queries as Q
from ridgeline.plans import queries_more, queries_view  # noqa: F401
from ridgeline.sources.surrogate import TABLES


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    def value(x):
        if isinstance(x, float) and math.isnan(x):
            return None
        return x

    return sorted(str(tuple(value(x) for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_rows(spark, sf, con, name):
    got = Q.QUERIES[name](spark, sf)
    expected = con.sql(Q.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    picked = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({Q.ORACLES[name]})").fetchall()
    assert plain(map(tuple, got.select(*columns).collect())) == plain(picked)


@pytest.mark.parametrize("name", sorted(q for q in set(Q.QUERIES) - set(Q.ORACLES)))
def test_rows_do_not_depend_on_the_deal(spark, sf, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = []
    try:
        for n in (before, "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows.append(plain(map(tuple, Q.QUERIES[name](spark, sf).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows[0] == rows[1] and rows[0]
