"""Each query against its SQL on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from flowloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = [tuple(map(plain, r)) for r in df.select(*cols).collect()]
    want = [tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({catalogue.ORACLES[name]})").fetchall()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
