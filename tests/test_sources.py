import datetime as dt
import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.plans.runner import Runner, Stage
from cellweave.sources import grids, listing, sinks

D = dt.date


def put(path, data=b"x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def netcdf(**variables):
    """A classic file: dimensions by length, variables of int16, int32 or float."""
    lengths = sorted({n for v in variables.values() for n in v.shape})
    text = lambda s: struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    codes = {"i2": 3, "i4": 4, "f4": 5, "f8": 6}
    head = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, len(lengths)) + b"".join(text(f"d{n}") + struct.pack(">i", n) for n in lengths)
    head += struct.pack(">ii", 12, 1) + text("title") + struct.pack(">ii", 2, 3) + b"abc\0" + struct.pack(">ii", 11, len(variables))
    raw = {k: v.astype(">" + v.dtype.str[1:]).tobytes() for k, v in variables.items()}
    size = lambda k: -(-len(raw[k]) // 4) * 4
    entries = lambda at: b"".join(text(k) + struct.pack(">i", v.ndim) + b"".join(struct.pack(">i", lengths.index(n)) for n in v.shape) + struct.pack(">iii", 0, 0, codes[v.dtype.str[1:]]) + struct.pack(">ii", size(k), at[k]) for k, v in variables.items())
    start, at = len(head) + len(entries(dict.fromkeys(variables, 0))), {}
    for k in variables:
        at[k], start = start, start + size(k)
    return head + entries(at) + b"".join(raw[k].ljust(size(k), b"\0") for k in variables)


def test_convective_files_are_a_union_of_two_days(spark, tmp_path):
    for day, names in (("2016/07/20", ["a_20160720-115900.netcdf", "a_20160720-120000.netcdf", "b_20160720-130000.NETCDF.GZ", "c_20160720-130000.txt"]), ("2016/07/21", ["a_20160721-115959.netcdf.gz", "a_20160721-120000.netcdf"])):
        for n in names:
            put(tmp_path / day / n)
    got = [r.path.rsplit("/", 1)[1] for r in listing.convective_files(spark, str(tmp_path), D(2016, 7, 20)).collect()]
    assert got == ["a_20160720-120000.netcdf", "b_20160720-130000.NETCDF.GZ", "a_20160721-115959.netcdf.gz"]
    assert listing.list_files(spark, str(tmp_path), [D(2016, 7, 20)]).count() == 3
    assert listing.list_files(spark, str(tmp_path), [D(1999, 1, 1)]).isEmpty()
    put(tmp_path / "flat" / "20160720" / "x.grib2.gz")
    assert listing.list_files(spark, str(tmp_path / "flat"), [D(2016, 7, 20)], "%Y%m%d", (".grib2.gz",)).count() == 1


def test_staged_files_by_day(spark, tmp_path):
    for day in ("2016-07-20", "2016-07-21", "2016-07-22"):
        put(tmp_path / f"by_convective_day={day}" / "v.nc")
    assert listing.staged_files(spark, str(tmp_path), D(2016, 7, 21), D(2016, 7, 22)).count() == 2


def test_download_plan_has_each_output_once(spark):
    days = listing.days_between(spark, D(2016, 12, 31), D(2017, 1, 1)).unionByName(listing.days_between(spark, D(2017, 1, 1), D(2017, 1, 1)))
    plan = listing.download_plan(days, "u/{date}/{hour}", "o/{date}{hour}.nc").orderBy("out_path").collect()
    assert len(plan) == 48 and plan[0].out_path == "o/2016123112.nc" and plan[-1].out_path == "o/2017010211.nc" and plan[-1].day == D(2017, 1, 1) and plan[12].url == "u/20170101/00"
    assert listing.days_between(spark, D(2017, 1, 1), D(2017, 1, 1)).select(listing.day_path("r", F.col("day"), ".tif").alias("p")).first().p == "r/2017/mesh_20170101.tif"


def test_source_choice(spark):
    days = spark.createDataFrame([(D(2016, 1, d),) for d in (1, 2, 3)], "day date")
    fine = spark.createDataFrame([(D(2016, 1, 1), True), (D(2016, 1, 2), False)], "day date, covered boolean")
    assert {r.day.day: r.choice for r in listing.choose_source(fine, days).collect()} == {1: "fine", 2: "fine+gap_fill", 3: "coarse"}


def test_files_are_decompressed(spark, tmp_path):
    put(tmp_path / "a.nc.gz", gzip.compress(b"data"))
    put(tmp_path / "b.nc", b"plain")
    put(tmp_path / "c.nc.gz", b"broken")
    got = {r.path.rsplit("/", 1)[1]: r.content for r in listing.decoded(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got == {"a.nc.gz": b"data", "b.nc": b"plain", "c.nc.gz": None}


def test_classic_netcdf_round_trip():
    rng = np.random.default_rng(0)
    fields = {"f": rng.normal(size=(3, 4)).astype("f4"), "g": rng.normal(size=4), "h": rng.integers(-9, 9, 3).astype("i2"), "k": np.arange(4, dtype="i4")}
    got = grids.read_netcdf(netcdf(**fields))
    assert set(got) == set(fields) and all((got[k] == v).all() for k, v in fields.items())
    with pytest.raises(ValueError):
        grids.read_netcdf(b"HDF")


def test_grids_are_decoded(spark, tmp_path):
    v = np.array([10.0, 20.0, 301.0, np.nan, -99900.0, 7.0, 5.0], "f4")
    rows = np.array([500, 504, 500, 500, 500, 499, 3099], "i2")
    cols = np.array([500, 503, 600, 600, 600, 600, 6399], "i2")
    counts = np.array([1, 3, 1, 1, 1, 1, 2], "i4")
    put(tmp_path / "s.nc", netcdf(MESH=v, pixel_x=rows, pixel_y=cols, pixel_count=counts))
    dense = np.zeros((15, 20), "f4")
    dense[0, 3], dense[14, 19], dense[7, 7], dense[2, 2] = 30.0, 40.0, -5.0, 999.0
    put(tmp_path / "t.nc", netcdf(MESH=dense))
    put(tmp_path / "u.nc", b"nothing")
    out = grids.decode_grids(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    by = lambda n: {(r.cell_row, r.cell_col): r.mm for r in out if r.path.endswith(n)}
    assert by("s.nc") == {(0, 0): 20.0, (0, 1): 20.0, (519, 1179): 5.0}
    assert by("t.nc") == {(2, 0): 30.0, (0, 3): 40.0}
    assert [r.error for r in out if r.path.endswith("u.nc")] == ["not a classic NetCDF file"]


def test_manifest_versions(spark, tmp_path):
    schema, path = "date string, status string, n int", str(tmp_path / "m")
    assert sinks.read_manifest(spark, path, schema).isEmpty()
    assert sinks.upsert_manifest(spark, path, spark.createDataFrame([("20160102", "ok", 2), ("20160101", "error", 0)], schema)) == 1
    assert sinks.upsert_manifest(spark, path, spark.createDataFrame([("20160101", "ok", 5)], schema)) == 2
    assert [tuple(r) for r in sinks.read_manifest(spark, path, schema).collect()] == [("20160101", "ok", 5), ("20160102", "ok", 2)]
    assert sinks.upsert_manifest(spark, path, spark.createDataFrame([("20160103", "no_hail_pixels", 0), ("20160103", "ok", 1)], schema)) == 3
    assert [tuple(r) for r in sinks.read_manifest(spark, path, schema).collect()] == [("20160101", "ok", 5), ("20160102", "ok", 2), ("20160103", "ok", 1)]
    with pytest.raises(Exception, match="lost"):  # dies while it writes: nothing of it is there, and nothing blocks the next
        sinks.upsert_manifest(spark, path, spark.createDataFrame([("20160101", "bad", 9)], schema).withColumn("status", F.when(F.col("n") == 9, F.raise_error(F.lit("lost"))).otherwise(F.col("status"))))
    assert sinks.read_manifest(spark, path, schema).first().n == 5
    assert sinks.upsert_manifest(spark, path, spark.createDataFrame([("20160101", "ok", 6)], schema)) == 4
    assert sinks.read_manifest(spark, path, schema).first().n == 6


def test_tables_and_sinks(spark, tmp_path):
    cells = spark.createDataFrame([(D(2010, 1, 1), 0, 0, 10.0), (D(2011, 1, 1), 0, 1, 50.0)], "day date, cell_row int, cell_col int, mm double")
    sinks.write_tagged(cells, str(tmp_path / "t"), {"units": "mm", "n": 2})
    assert sinks.read_tags(spark, str(tmp_path / "t")) == {"units": "mm", "n": "2"}
    tags = spark.createDataFrame([(D(2010, 1, 1), 12.0), (D(2012, 1, 1), None)], "day date, max_mm double")
    assert {r.day.year: r.peak_mm for r in sinks.peaks(cells, tags).collect()} == {2010: 12.0, 2011: 50.0, 2012: 0.0}
    events = spark.range(1, 11).selectExpr("id AS sim_year", "id * 2 AS event_idx")
    for _ in range(2):
        sinks.append_events(events, str(tmp_path / "e"), 1, 5, 2)
        sinks.append_events(events, str(tmp_path / "e"), 6, 10, 2)
    assert spark.read.parquet(str(tmp_path / "e")).count() == 10 and sinks.largest(spark, str(tmp_path / "e"), "sim_year") == 10
    assert len(list((tmp_path / "e" / "span=0000001-0000005").glob("*.parquet"))) >= 3
    sinks.write_sorted(cells, str(tmp_path / "s"), "mm")
    sinks.write_single(cells, str(tmp_path / "c"))
    sinks.write_single(cells, str(tmp_path / "j"), "json")
    assert [len(list((tmp_path / x).glob("part-*"))) for x in ("c", "j")] == [1, 1]
    catalog = spark.createDataFrame([(1, 5.0), (2, 6.0)], "event_id long, peak double")
    own = spark.createDataFrame([(2, 1, 1, 6.0), (2, 0, 1, 5.0)], "event_id long, cell_row int, cell_col int, mm double")
    sinks.write_event_table(catalog, own, str(tmp_path / "x"))
    got = {r.event_id: [tuple(c) for c in r.cells or []] for r in sinks.read_event_table(spark, str(tmp_path / "x")).collect()}
    assert got == {1: [], 2: [(0, 1, 5.0), (1, 1, 6.0)]}
    sinks.write_sites(spark.createDataFrame([("KB", 30.0, -90.0), ("KA", 31.0, -91.0)], "site_id string, lat double, lon double"), str(tmp_path / "sites"))
    assert [(r.site_idx, r.site_id) for r in sinks.read_sites(spark, str(tmp_path / "sites")).orderBy("site_idx").collect()] == [(0, "KA"), (1, "KB")]


def test_elevation(spark):
    points = spark.createDataFrame([(49.99, -124.99, 100.0), (49.98, -124.98, -50.0), (49.97, -124.97, float("nan")), (10.0, -124.0, 5.0)], "lat double, lon double, elevation_m double")
    assert [tuple(r) for r in grids.resample_elevation(points).collect()] == [(0, 0, pytest.approx(100 / 3))]


def test_runner(spark, tmp_path):
    faults = []
    stages = [
        Stage("one", lambda read: spark.range(3)),
        Stage("two", lambda read: read("one").selectExpr("id * 2 AS id"), lambda df: faults),
        Stage("three", lambda read: read("two").selectExpr("id + 1 AS id")),
    ]
    run = Runner(spark, str(tmp_path), stages)
    assert run.run(dry=True) == [(n, "planned") for n in ("one", "two", "three")]
    assert run.run(only=("one", "two")) == [("one", "written"), ("two", "written")]
    assert run.run() == [("one", "kept"), ("two", "kept"), ("three", "written")]
    assert sorted(r.id for r in run.read("three").collect()) == [1, 3, 5]
    assert run.clean_from("two") == ["two", "three"] and not run.done("three")
    assert run.validate(start="one") == {"one": [], "two": ["no output"], "three": ["no output"]}
    assert run.run(start="two", skip=("three",), clean=True) == [("two", "written")]
    faults.append("bad")
    with pytest.raises(RuntimeError, match="two: bad"):
        run.run(validate=True)
    with pytest.raises(ValueError):
        run.run(only=("four",))
