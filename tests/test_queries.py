"""Every registered query with SQL against DuckDB on the smallest tables; the rest must run."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    r = c.execute(entry.oracle_sql()[name])
    names, want = [d[0] for d in r.description], r.fetchall()
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(names) == cols
    got = sorted(repr([norm(x[k]) for k in cols]) for x in df.collect())
    assert got == sorted(repr([norm(x[names.index(k)]) for k in cols]) for x in want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["html_listings", "html_links", "html_facts", "stated_attributes", "p1_found"])
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() >= 0
