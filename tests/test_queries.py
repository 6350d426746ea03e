"""Each registered query against its SQL in DuckDB, over the smallest tables, if they are there."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def value(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    if name not in entry.oracle_sql():
        assert got
        return
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(str([value(r[c]) for c in columns]) for r in got) == sorted(str([value(r[i]) for i in at]) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
