"""The nearest site by nested cubes against a comparison with all sites."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import nearest
from cellweave.operators.nearest import nearest_site
from cellweave.sources.shared import keep

EARTH = 6371.0


def plain(places, sites):
    """km and index of each place's nearest, in blocks; ties by the least index."""
    phi2, lam2 = np.radians(sites[:, 1]), np.radians(sites[:, 2])
    out = []
    for a in range(0, len(places), 50):
        phi1, lam1 = (np.radians(places[a : a + 50, i, None]) for i in (0, 1))
        h = np.sin((phi2 - phi1) / 2) ** 2 + np.cos(phi1) * np.cos(phi2) * np.sin((lam2 - lam1) / 2) ** 2
        km = np.round(2 * EARTH * np.arcsin(np.sqrt(np.clip(h, 0, 1))), 6)
        best = km.min(1)
        out += [(int(sites[np.flatnonzero(row <= b + 1.1e-6), 0].min()), b, set(sites[np.flatnonzero(np.abs(row - b) <= 1.1e-6), 0].astype(int))) for row, b in zip(km, best, strict=True)]
    return out


def compare(spark, places, sites):
    cells = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(places)], "id int, lat double, lon double")
    frame = spark.createDataFrame([(int(i), float(a), float(b)) for i, a, b in sites], "site_idx long, site_lat double, site_lon double")
    got = {r.id: r for r in nearest_site(cells, frame, F.col("lat"), F.col("lon"), keep).collect()}
    assert len(got) == len(places)
    for i, (least, km, ties) in enumerate(plain(places, sites)):
        assert got[i].km == pytest.approx(km, abs=1.1e-6)
        assert got[i].site_idx in ties and (len(ties) == 1 or got[i].site_idx == least or got[i].km < km + 1e-9)


def sphere(rng, n):
    return np.column_stack([np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)])


@pytest.fixture
def by_cubes(monkeypatch):
    monkeypatch.setattr(nearest, "FEW", 0)


@pytest.mark.parametrize("n", [1, 300])
def test_few_sites(spark, n):
    rng = np.random.default_rng(n)
    compare(spark, sphere(rng, 600), np.column_stack([rng.permutation(n), sphere(rng, n)]))


@pytest.mark.parametrize("n", [1, 16, 17, 300, 4000])
def test_sites_all_over_the_sphere(spark, by_cubes, n):
    rng = np.random.default_rng(n)
    places = np.concatenate([sphere(rng, 300), [[90, 0], [-90, 50], [0, 180], [0, -180], [89.99, -179.99]]])
    compare(spark, places, np.column_stack([rng.permutation(n), sphere(rng, n)]))


def test_clusters_near_and_far(spark, by_cubes):
    """Most sites within metres of each other, some alone; places beside, between and on the other side."""
    rng = np.random.default_rng(2)
    dense = np.column_stack([40 + rng.normal(0, 1e-4, 3000), -100 + rng.normal(0, 1e-4, 3000)])
    sites = np.concatenate([dense, [[45.0, -110.0], [30.0, -80.0], [-20.0, 60.0]]])
    places = np.concatenate([dense[:20] + 1e-5, np.column_stack([rng.uniform(25, 50, 200), rng.uniform(-125, -65, 200)]), sphere(rng, 50)])
    compare(spark, places, np.column_stack([rng.permutation(len(sites)), sites]))


def test_a_hundred_thousand_sites_with_ties(spark):
    """A lattice of sites and places at the middle of its edges and meshes, so that two or four sites tie."""
    lat, lon = np.meshgrid(np.arange(0, 20, 0.05), np.arange(-100, -87.5, 0.05), indexing="ij")
    sites = np.column_stack([np.random.default_rng(3).permutation(lat.size), lat.ravel(), lon.ravel()])
    assert len(sites) == 100_000
    rng = np.random.default_rng(4)
    at = np.column_stack([rng.integers(1, 399, 250) * 0.05, -100 + rng.integers(1, 249, 250) * 0.05])
    places = np.concatenate([at + [0, 0.025], at[:60] + [0.0251, 0.0], at[:40], at[:60] + rng.uniform(-0.02, 0.02, (60, 2)), [[60, 10], [-30, -95]]])
    cells = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(places)], "id int, lat double, lon double")
    frame = spark.createDataFrame([(int(i), float(a), float(b)) for i, a, b in sites], "site_idx long, site_lat double, site_lon double")
    got = {r.id: r for r in nearest_site(cells, frame, F.col("lat"), F.col("lon"), keep).collect()}
    ties = 0
    for i, (least, km, equal) in enumerate(plain(places, sites)):
        assert got[i].km == pytest.approx(km, abs=1.1e-6) and got[i].site_idx in equal
        ties += len(equal) > 1
        assert len(equal) == 1 or got[i].site_idx == least or abs(got[i].km - km) < 2e-6
    assert ties > 200


@pytest.mark.parametrize("few", [0, 4096])
def test_repeated_places_and_missing_ones(spark, monkeypatch, few):
    monkeypatch.setattr(nearest, "FEW", few)
    cells = spark.createDataFrame([(1, 40.0, -100.0), (1, 40.0, -100.0), (2, None, -100.0), (3, 41.0, None)], "site_idx_of int, lat double, lon double")
    sites = spark.createDataFrame([(7, 40.0, -100.0), (3, 40.0, -100.0), (1, None, 2.0), (None, 40.0, -100.0)], "site_idx long, site_lat double, site_lon double")
    got = sorted((r.site_idx_of, r.site_idx, r.km) for r in nearest_site(cells, sites, F.col("lat"), F.col("lon"), keep).collect())
    assert got == [(1, 3, 0.0), (1, 3, 0.0), (2, None, None), (3, None, None)]
    none = nearest_site(cells, sites.limit(0), F.col("lat"), F.col("lon"), keep).collect()
    assert len(none) == 4 and all(r.site_idx is None for r in none)
