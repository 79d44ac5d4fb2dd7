"""Every registered query that has SQL gives DuckDB's rows, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()


def norm(rows):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    df = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    out = db.sql(SQL[name])
    assert sorted(out.columns) == cols
    names = ", ".join(f'"{c}"' for c in cols)
    want = db.sql(f"SELECT {names} FROM ({SQL[name]})").fetchall()
    assert norm(got) == norm(want)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["job", "window_start", "value"] and df.count() > 0
