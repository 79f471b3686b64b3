"""Polygons by tiles against the ray test over all edges: concave and nested rings, shared borders, edges on tile borders."""

import random

import pytest

from cellweave.operators import polygons

CORNERS = "polygon string, ring int, seq int, lat double, lon double"
SHAPES = {
    "square": [[(0, 0), (0, 10), (10, 10), (10, 0)]],
    "next": [[(0, 10), (0, 20), (10, 20), (10, 10)]],
    "ring": [[(-5, -5), (-5, 25), (15, 25), (15, -5)], [(2, 2), (8, 2), (8, 8), (2, 8)], [(4, 4), (4, 6), (6, 6), (6, 4)]],
    "star": [[(12.3, 3.1), (3.2, 9.4), (11.9, 18.8), (-2.7, 14.1), (5.5, 0.2)]],
    "apart": [[(20, 0), (21.25, 3.5), (20.5, 7)], [(-9, 0), (-8, 0.01), (-9, 0.02)]],
    "closed": [[(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)]],
    "line": [[(0, 0), (5, 5)]],
    "lost": [[(0, 0), (None, 5), (5, 5)]],
}


def inside(lat, lon, rings):
    odd = False
    for ring in rings:
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            if a != c and min(a, c) <= lat < max(a, c):
                (lo, lo_lon), (hi, hi_lon) = sorted([(a, b), (c, d)])
                odd ^= lon < lo_lon + (lat - lo) * (hi_lon - lo_lon) / (hi - lo)
    return odd


@pytest.fixture(scope="module")
def vertices(spark):
    return spark.createDataFrame([(name, r, i, *map(lambda x: None if x is None else float(x), corner)) for name, rings in SHAPES.items() for r, ring in enumerate(rings) for i, corner in enumerate(ring)], CORNERS)


@pytest.mark.parametrize("side", [0.5, 3.0, 100.0])
def test_points_in_polygons(spark, vertices, side):
    rng = random.Random(1)
    points = [(rng.uniform(-12, 25), rng.uniform(-10, 30)) for _ in range(1500)] + [(float(a), float(b)) for a in range(-6, 17) for b in range(-6, 27)] + [(1.5, 1.5)] * 3
    rows = [(i, a, b, "x") for i, (a, b) in enumerate(points)] + [(-1, None, 3.0, "x"), (-2, 3.0, float("nan"), "x")]
    out = polygons.polygons_of(spark.createDataFrame(rows, "id int, lat double, lon double, ring string"), vertices, side)
    got = sorted((r.id, r.polygon) for r in out.collect())
    assert got == sorted((i, name) for i, (a, b) in enumerate(points) for name, rings in SHAPES.items() if name not in ("line", "lost") and inside(a, b, rings))
    assert out.columns == ["id", "lat", "lon", "ring", "polygon"]
    both = {i for i, name in got if name == "square"} & {i for i, name in got if name == "next"}
    assert not both


def test_whole_tiles_need_no_edges(spark, vertices):
    index, held = polygons.tile_index(polygons.ring_edges(vertices.where("polygon = 'ring'")), 1.0)
    tiles = {(r.band, r.column): r.crossed for r in index.collect()}
    assert tiles[0, 0] is False and tiles[10, 20] is False and (3, 3) not in tiles  # inside twice, in the hole
    assert tiles[2, 2] and tiles[-5, -5] and (16, 0) not in tiles
    assert sum(tiles.values()) < 0.4 * len(tiles)
    assert {r.band: len(r.edges) for r in held.collect()}[5] == 6


def test_mask(spark, vertices):
    cells = spark.createDataFrame([(r, c, float(r) - 8.5, float(c) - 7.5) for r in range(30) for c in range(40)], "cell_row int, cell_col int, lat double, lon double")
    got = {(r.cell_row, r.cell_col): r.land for r in polygons.mask_of(cells, vertices).collect()}
    assert got == {(r, c): any(inside(r - 8.5, c - 7.5, rings) for name, rings in SHAPES.items() if name not in ("line", "lost")) for r in range(30) for c in range(40)}


def test_nothing(spark, vertices):
    points = spark.createDataFrame([(1, 2.0, 3.0)], "id int, lat double, lon double")
    assert polygons.polygons_of(points, vertices.limit(0)).collect() == []
    assert polygons.polygons_of(points.limit(0), vertices).collect() == []
