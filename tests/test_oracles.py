"""Every registered query against its SQL, on the smallest data."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
        return "" if v is None else str(v)

    return sorted(tuple(map(norm, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    a = plain(df.select(*(f"`{c}`" for c in cols)).collect())
    b = plain(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert len(a) == len(b) and a == b


def test_entry(spark):
    assert entry.entry(spark).columns == ["channel", "onset_idx", "offset_idx", "amplitude", "duration"]


def test_registry():
    assert set(ORACLES) <= set(entry.queries())
