"""Every query with SQL gives the rows of its SQL."""

import collections
import glob
import math
import os

import duckdb
import pytest

from auricle.plans import catalogue


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_matches_sql(spark, data, con, name):
    df = catalogue.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = con.execute(catalogue.oracles()[name])
    at = [[d[0] for d in res.description].index(c) for c in cols]
    assert got == collections.Counter(tuple(norm(r[i]) for i in at) for r in res.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["metadata_id", "listeners", "position"]
