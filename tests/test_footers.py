"""Parquet footers: equal to the data, fall back where they don't tell, and read no data page."""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cellweave.sources import footers


@pytest.fixture
def table(spark, tmp_path):
    footers.register(spark)
    for i in range(3):
        rows = {"year": [2000 + i * 7, 1999, None], "day": [dt.date(2001, 5, 1), dt.date(2010 + i, 1, 2), None], "name": ["b", f"z{i}", "a"], "ok": [True, False, None], "none": pa.array([None] * 3, pa.float64())}
        os.makedirs(tmp_path / f"t/part={i}", exist_ok=True)
        pq.write_table(pa.table(rows), tmp_path / f"t/part={i}/f.parquet", row_group_size=2)
    os.makedirs(tmp_path / "t/_temporary", exist_ok=True)
    (tmp_path / "t/_temporary/x.parquet").write_bytes(b"not a table")
    return str(tmp_path / "t")


def test_statistics(spark, table):
    rows = spark.read.format("parquet_footers").load(table).collect()
    assert len(rows) == 3 * 2 * 5 and {r.row_group for r in rows} == {0, 1}
    out = {r.column: r for r in footers.table_statistics(spark, table).collect()}
    assert (out["year"].n_rows, out["year"].n_nulls, out["year"].low_number, out["year"].high_number) == (9, 3, 1999.0, 2014.0)
    assert (out["day"].low, out["day"].high) == ("2001-05-01", "2012-01-02") and (out["name"].low, out["name"].high) == ("a", "z2")
    assert (out["none"].n_nulls, out["none"].low_number) == (9, None)
    assert footers.largest_year(spark, table, "year") == 2014 and footers.largest_year(spark, table, "day") == 2012


def test_without_statistics_the_column_is_read(spark, table):
    rows = pa.table({"year": [2050], "day": [dt.date(2051, 1, 1)]})
    pq.write_table(rows, f"{table}/g.parquet", write_statistics=False)
    spark.catalog.refreshByPath(table)
    out = {r.column: r for r in footers.table_statistics(spark, table).collect()}
    assert out["year"].high_number is None and out["year"].n_nulls is None and out["year"].n_rows == 10
    flat = f"{table}-flat"
    os.makedirs(flat)
    pq.write_table(rows, f"{flat}/g.parquet", write_statistics=False)
    assert footers.largest_year(spark, flat, "year") == 2050 and footers.largest_year(spark, flat, "day") == 2051


def test_data_pages_are_not_read(spark, table):
    """Everything before the footer is overwritten."""
    path = f"{table}/part=2/f.parquet"
    data = bytearray(open(path, "rb").read())
    length = int.from_bytes(data[-8:-4], "little")
    data[4 : len(data) - 8 - length] = b"\xff" * (len(data) - 12 - length)
    open(path, "wb").write(data)
    assert footers.largest_year(spark, table, "year") == 2014


def test_a_single_file_and_an_empty_folder(spark, table, tmp_path):
    assert footers.largest_year(spark, f"{table}/part=0/f.parquet", "year") == 2000
    os.makedirs(tmp_path / "empty")
    assert footers.table_statistics(spark, str(tmp_path / "empty")).collect() == []
