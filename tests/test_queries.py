"""Every registered query with SQL against DuckDB on the supplied tables."""

import os

import pytest

import __spark_entry__ as entry
from cellweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def normal(frame):
    import pandas as pd

    frame = frame[sorted(frame.columns)].copy()
    for c in frame:
        if frame[c].dtype == object or str(frame[c].dtype).startswith("datetime"):
            frame[c] = frame[c].astype(str).str.replace(" 00:00:00", "")
        else:
            frame[c] = pd.to_numeric(frame[c]).astype(float)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, con, name):
    import pandas as pd

    got = normal(registry.QUERIES[name](spark, SF).toPandas())
    want = normal(con.sql(registry.SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_exact=False, atol=2e-6, rtol=1e-9)


def test_entry(spark):
    assert not entry.entry(spark).isEmpty()
    assert set(entry.oracle_sql()) <= set(entry.queries())
