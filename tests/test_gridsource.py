"""Grid files as a data source: equal to the decoder, filters reach the listing, files round-trip with their tags."""

import datetime as dt
import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.sources import grids
from cellweave.sources import gridsource as G


@pytest.fixture
def source(spark):
    for k, v in G.PUSHDOWN.items():
        spark.conf.set(k, v)
    G.register(spark)
    yield spark.read.format("grid_files")
    for k in G.PUSHDOWN:
        spark.conf.unset(k)


def sparse(seed, n=40):
    rng = np.random.default_rng(seed)
    return grids.write_netcdf({"MESH": rng.uniform(-5, 320, n).astype("f4"), "pixel_x": rng.integers(495, 700, n).astype("i4"), "pixel_y": rng.integers(495, 700, n).astype("i4")}, {"source": f"s{seed}"})


def put(root, name, content):
    folder = f"{root}/{name[2:6]}/{name[6:8]}/{name[8:10]}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(gzip.compress(content) if name.endswith(".gz") else content)


@pytest.fixture
def root(tmp_path):
    for i, name in enumerate(["a_20160720-115900.netcdf", "a_20160720-120000.netcdf", "a_20160720-130000.NETCDF.gz", "a_20160721-113000.nc", "a_20160721-120000.netcdf", "a_20160801-000000.netcdf"]):
        put(tmp_path, name, sparse(i))
    put(tmp_path, "a_20160722-000000.netcdf", b"broken")
    put(tmp_path, "a_20160722-010000.netcdf.gz", sparse(7))
    with open(tmp_path / "2016/07/22/a_20160722-020000.netcdf.gz", "wb") as f:
        f.write(b"not gzip")
    put(tmp_path, "a_20160722-030000.txt", b"other")
    put(tmp_path, "a_20160722-nothing.nc", grids.write_netcdf({"MESH": np.full((3500, 7000), 7.0, "f4")[:40, :40]}, {}))
    return str(tmp_path)


def test_rows_are_those_of_the_decoder(spark, source, root):
    from cellweave.sources.listing import decoded

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where("not endswith(path, '.txt')")
    want = grids.decode_grids(decoded(files))
    names = lambda rows: sorted((os.path.basename(r.path), r.cell_row, r.cell_col, r.mm) for r in rows.collect() if r.error is None)
    got = source.load(root)
    assert len(names(got)) > 200 and names(got) == names(want)
    broken = lambda rows: {os.path.basename(r.path) for r in rows.collect() if r.error}
    assert broken(got) == broken(want) == {"a_20160722-000000.netcdf", "a_20160722-020000.netcdf.gz"}
    by_day = {r.day: r.n for r in got.groupBy("day").agg(F.count_distinct("path").alias("n")).collect()}
    assert by_day == {dt.date(2016, 7, 19): 1, dt.date(2016, 7, 20): 3, dt.date(2016, 7, 21): 4, dt.date(2016, 7, 31): 1, None: 1}


@pytest.mark.parametrize(
    "condition, days",
    [
        ("day = '2016-07-20'", {20}),
        ("day >= '2016-07-20' and day < '2016-07-22'", {20, 21}),
        ("day in ('2016-07-19', '2016-07-31')", {19, 31}),
        ("day > '2016-07-21'", {31}),
        ("day = '2016-07-20' or cell_row = 3", None),
        ("day > '2016-07-25' and day < '2016-07-20'", set()),
    ],
)
def test_filters_on_the_day(spark, source, root, condition, days):
    every = [tuple(r) for r in source.load(root).where(condition).collect()]
    plain = [tuple(r) for r in source.load(root).withColumn("day", F.expr("date_add(day, 0)")).where(condition).collect()]
    assert sorted(map(str, every)) == sorted(map(str, plain))
    if days is not None:
        assert {r[2].day for r in every} == days


def test_files_of_other_days_are_not_opened(root, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    opened, listed = [], []
    where, _ = G.store(root)

    class Watched:
        def get_file_info(self, selector):
            listed.append(selector.base_dir[len(root) + 1 :])
            return where.get_file_info(selector)

        def open_input_stream(self, path, **how):
            opened.append(os.path.basename(path))
            return where.open_input_stream(path, **how)

    monkeypatch.setattr(G, "store", lambda path: (Watched(), path))

    def read(*filters):
        opened.clear()
        listed.clear()
        reader = G.GridFiles({"path": root}).reader(None)
        assert list(reader.pushFilters(list(filters))) == list(filters)
        for p in reader.partitions():
            list(reader.read(p))
        return sorted(opened)

    day = lambda n: dt.date(2016, 7, n)
    assert read(EqualTo(("day",), day(20))) == ["a_20160720-120000.netcdf", "a_20160720-130000.NETCDF.gz", "a_20160721-113000.nc"]
    assert listed == ["2016/07/20", "2016/07/21"]
    assert read(In(("day",), (day(19), day(31)))) == ["a_20160720-115900.netcdf", "a_20160801-000000.netcdf"]
    assert read(GreaterThanOrEqual(("day",), day(25))) == ["a_20160801-000000.netcdf"]
    assert read(GreaterThanOrEqual(("day",), day(20)), LessThan(("day",), day(10))) == [] and listed == []
    assert len(read(EqualTo(("cell_row",), 3))) == 10


def test_files_are_grouped_by_bytes(root):
    reader = G.GridFiles({"path": root, "groupbytes": "1500"}).reader(None)
    parts = reader.partitions()
    assert len(parts) > 3 and sorted(x for p in parts for x in p.paths) == reader.listed()


def test_written_files_and_tags(spark, source, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(dt.datetime(2015, 6, 1 + i % 3, 6 * (i % 4)), int(rng.integers(0, 2600)), int(rng.integers(0, 5900)), float(rng.integers(1, 300))) for i in range(500)]
    cells = spark.createDataFrame(rows, "ts timestamp_ntz, row int, col int, mm double")
    G.write_grids(cells, str(tmp_path), {"units": "mm", "era": "2015 to 2016"})
    G.write_grids(cells.where("ts < '2015-06-02'"), str(tmp_path), {"units": "mm", "era": "again"})
    want = {}
    for ts, r, c, mm in rows:
        if r // 5 < 520 and c // 5 < 1180:
            want[ts, r // 5, c // 5] = max(want.get((ts, r // 5, c // 5), 0), mm)
    got = source.load(str(tmp_path))
    assert {(r.ts, r.cell_row, r.cell_col): r.mm for r in got.collect()} == want
    tags = source.option("content", "tags").load(str(tmp_path)).collect()
    assert {r.ts: r.tags["era"] for r in tags} == {ts: "again" if ts.day == 1 else "2015 to 2016" for ts, *_ in rows}
    assert not [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".part")]
    with pytest.raises(Exception, match="append"):
        cells.write.format("grid_files").mode("overwrite").option("path", str(tmp_path)).save()


def test_netcdf_round_trip():
    rng = np.random.default_rng(6)
    fields = {"a": rng.normal(size=(3, 5)).astype("f8"), "b": rng.integers(-9, 9, 5).astype("i2"), "c": np.arange(7, dtype="i1"), "d": np.zeros(0, "f4")}
    data = grids.write_netcdf(fields, {"k": "v", "long name": "é" * 5, "": ""})
    assert {k: v.tolist() for k, v in grids.read_netcdf(data).items()} == {k: v.tolist() for k, v in fields.items()}
    assert grids.read_tags(data) == {"k": "v", "long name": "é" * 5, "": ""}


def elevation(seed, n_lat=40, n_lon=90):
    rng = np.random.default_rng(seed)
    lat, lon = np.linspace(30, 31, n_lat), np.linspace(-100, -98, n_lon)
    return lat, lon, rng.uniform(-50, 3000, (n_lat, n_lon)).astype("f4")


def test_elevation_models_as_points(spark, source, tmp_path):
    """Rows of a dense field with coordinates, from one file and from a folder, averaged over cells."""
    lat, lon, z = elevation(1)
    (tmp_path / "dem").mkdir()
    (tmp_path / "dem" / "a.nc").write_bytes(grids.write_netcdf({"Latitude": lat, "lon": lon, "z": z}, {"units": "m" * 70_000}))
    for path in ("dem/a.nc", "dem"):
        rows = source.option("content", "points").option("value", "z").option("groupbytes", "3000").load(f"{tmp_path}/{path}")
        assert rows.rdd.getNumPartitions() == 5
        got = {(r.lat, r.lon): r.value for r in rows.collect()}
        assert got == {(a, b): float(z[i, j]) for i, a in enumerate(lat) for j, b in enumerate(lon)}
    cells = {(r.cell_row, r.cell_col): r.elevation_m for r in grids.resample_elevation(rows.withColumnRenamed("value", "elevation_m")).collect()}
    want = {}
    for i, a in enumerate(lat):
        for j, b in enumerate(lon):
            want.setdefault((int((50.005 - a) / 0.05), int((b + 125.005) / 0.05)), []).append(max(float(z[i, j]), 0.0))
    assert cells == {k: pytest.approx(np.mean(v)) for k, v in want.items()}
    with pytest.raises(Exception, match="no field q"):
        source.option("content", "points").option("value", "q").load(f"{tmp_path}/dem").collect()


def test_a_task_reads_its_rows_only(tmp_path):
    lat, lon, z = elevation(2, 4000, 90)
    (tmp_path / "a.nc").write_bytes(grids.write_netcdf({"lat": lat, "lon": lon, "z": z}, {}))
    reader = G.GridFiles({"path": f"{tmp_path}/a.nc", "content": "points", "value": "z", "groupbytes": "36000"}).reader(None)
    parts = reader.partitions()
    assert len(parts) == 40 and [(p.first, p.last) for p in parts[:2]] == [(0, 100), (100, 200)]
    data = bytearray((tmp_path / "a.nc").read_bytes())
    begin = parts[7].field[2]
    data[begin : begin + 700 * 360] = b"\xff" * (700 * 360)
    data[begin + 800 * 360 :] = b"\xff" * (len(data) - begin - 800 * 360)
    (tmp_path / "a.nc").write_bytes(data)
    values = np.concatenate([b.column("value").to_numpy() for b in reader.read(parts[7])])
    assert (values == z[700:800].ravel()).all()
