"""K-means of all starts at once against Lloyd's rounds one start at a time, and the rules of the regions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import models

SCHEMA = "cell_row int, cell_col int, f array<double>"


def frame(spark, x):
    return spark.createDataFrame([(i, 7 * i % 11, v.tolist()) for i, v in enumerate(x)], SCHEMA)


def plain_lloyd(x, centres):
    for _ in range(100):
        near = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        new = np.array([x[near == j].mean(0) if (near == j).any() else centres[j] for j in range(len(centres))])
        if np.abs(new - centres).max() <= 1e-9:
            return new, ((x[:, None] - new) ** 2).sum(2).min(1).sum()
        centres = new
    raise AssertionError


def test_all_starts_equal_plain_rounds(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.6, (60, 4)) for m in (0, 2, [5, 0, 0, 1])])
    rows = frame(spark, x).repartition(5)
    first, _ = models.lloyd(rows, 3, starts=4, rounds=0)
    assert all(min(np.abs(x - c).max(1)) == 0 for start in first for c in start) and len({tuple(s.ravel()) for s in first}) > 1
    at, cost = models.lloyd(rows, 3, starts=4)
    for s in range(4):
        want, total = plain_lloyd(x, first[s])
        assert np.allclose(at[s], want) and cost[s] == pytest.approx(total)
    again, _ = models.lloyd(rows.repartition(2), 3, starts=4)
    assert np.allclose(at, again)


def test_starts_lie_apart(spark):
    """Far points are more likely beginnings: with well separated groups every start finds each of them."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(40 * np.eye(4)[m], 0.5, (30, 4)) for m in range(4)])
    at, cost = models.lloyd(frame(spark, x), 4, starts=6)
    best = cost.argmin()
    assert sorted((at[best] / 40).round().argmax(1).tolist()) == [0, 1, 2, 3] and (cost < 2 * cost.min()).sum() >= 4


def annual(spark, cells, years=10):
    """(row, col) -> mean; a cell's annual maxima lie around it."""
    rng = np.random.default_rng(3)
    rows = [(2000 + y, r, c, float(m + rng.normal(0, 1))) for (r, c), (m, n) in cells.items() for y in range(n)]
    return spark.createDataFrame(rows, "year int, cell_row int, cell_col int, mm double")


def place():
    return F.lit(49.0) - F.col("cell_row"), F.lit(-120.0) + F.col("cell_col")


def test_regions_of_separate_climates(spark):
    cells = {(r, c): ((20, 9) if r < 5 else (60, 9)) for r in [0, 1, 2, 30, 31, 32] for c in range(12)}
    cells |= {(15, c): (30, 3) for c in range(4)}  # too few years
    out = {(r.cell_row, r.cell_col): r.region for r in models.region_clusters(annual(spark, cells), 10, *place(), k=2).collect()}
    assert out == {(r, c): -1 if r == 15 else int(r >= 30) for r, c in cells}


@pytest.mark.parametrize("n, regions", [(0, 0), (4, 1), (15, 1), (25, 2), (70, 6)])
def test_few_cells_have_few_regions(spark, n, regions):
    cells = {(i // 10, i % 10): (20 + i, 8) for i in range(n)} | {(90, 90): (5, 1)}
    out = {(r.cell_row, r.cell_col): r.region for r in models.region_clusters(annual(spark, cells), 10, *place()).collect()}
    assert len(out) == n + 1 and out.pop((90, 90)) == -1 and set(out.values()) == set(range(regions))


def test_short_records_ask_for_all_years(spark):
    cells = {(0, c): (20, 3) for c in range(12)} | {(1, c): (20, 2) for c in range(3)}
    out = models.region_clusters(annual(spark, cells), 3, *place()).where("region >= 0").collect()
    assert {r.cell_row for r in out} == {0}


def test_features(spark):
    cells = {(0, 0): (10, 5), (0, 1): (30, 10), (3, 1): (50, 10)}
    rows = annual(spark, cells)
    got = {(r.cell_row, r.cell_col): r.f for r in models.region_features(rows, 10, *place()).collect()}
    means = {(r.cell_row, r.cell_col): r.m for r in rows.groupBy("cell_row", "cell_col").agg(F.avg("mm").alias("m")).collect()}
    raw = np.array([[means[k], n / 10, 49.0 - k[0], -120.0 + k[1]] for k, (_, n) in cells.items()])
    assert np.allclose([got[k] for k in cells], (raw - raw.mean(0)) / raw.std(0))
    flat = models.region_features(annual(spark, {(0, 0): (10, 5)}), 10, *place()).first().f
    assert flat == [0.0] * 4
