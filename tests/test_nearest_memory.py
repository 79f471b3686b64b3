"""What a task holds while it looks for nearest sites or reads grid files."""

import os

import numpy as np
from pyspark.sql import functions as F

from cellweave.operators import nearest
from cellweave.sources import gridsource
from cellweave.sources.shared import keep


def test_sites_of_few_positions_are_compared_in_the_task(spark):
    kept = []
    cells = spark.createDataFrame([(1, 40.0, -100.0), (2, 10.0, 10.0)], "id int, lat double, lon double")
    sites = spark.range(6000).selectExpr("6000 - id as site_idx", "cast(id % 24 as double) + 25 as site_lat", "cast(id % 50 as double) - 120 as site_lon")
    got = {r.id: r.site_idx for r in nearest.nearest_site(cells, sites, F.col("lat"), F.col("lon"), lambda df, name: kept.append(name) or keep(df, name)).collect()}
    ids = np.arange(6000)
    lat, lon = np.radians(ids % 24 + 25.0), np.radians(ids % 50 - 120.0)
    for i, (a, b) in ((1, (40.0, -100.0)), (2, (10.0, 10.0))):
        a, b = np.radians(a), np.radians(b)
        km = np.round(2 * 6371.0 * np.arcsin(np.sqrt(np.sin((lat - a) / 2) ** 2 + np.cos(a) * np.cos(lat) * np.sin((lon - b) / 2) ** 2)), 6)
        assert got[i] == (6000 - ids)[km == km.min()].min()
    assert not kept


def test_a_place_stays_one_row_under_the_tree(spark, monkeypatch):
    """No row a place and candidate is sorted or grouped after the tree has named the candidates."""
    monkeypatch.setattr(nearest, "FEW", 0)
    rng = np.random.default_rng(5)
    sites = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(25, 49, 300), rng.uniform(-120, -70, 300), strict=True))], "site_idx long, site_lat double, site_lon double")
    cells = spark.createDataFrame([(i, 30.0 + i / 50, -100.0) for i in range(200)], "id int, lat double, lon double")
    found = nearest.nearest_site(cells, sites, F.col("lat"), F.col("lon"), keep)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "min(struct" not in plan and "array_min" in plan
    assert found.count() == 200


def test_a_partition_reads_eight_megabytes_of_files(tmp_path):
    for hour in range(5):
        path = tmp_path / f"2020/01/02/mesh_20200102-{hour:02}0000.netcdf"
        os.makedirs(path.parent, exist_ok=True)
        with open(path, "wb") as f:
            f.truncate(3 << 20)
    parts = gridsource.GridFiles({"path": str(tmp_path)}).reader(None).partitions()
    assert [len(p.paths) for p in parts] == [2, 2, 1]
