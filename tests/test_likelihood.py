"""Likelihood fits: known answers, agreement with the narrowing search, pooled fits, awkward groups."""

import numpy as np
import pytest

from cellweave.operators import likelihood


def drawn(rng, xi, scale, n):
    u = rng.random(n)
    return -scale * np.log(u) if xi == 0 else scale * (u**-xi - 1) / xi


def test_known_answers_and_the_narrowing_search(spark):
    from cellweave.operators.legacy import fit_gpd

    rng = np.random.default_rng(1)
    truth = {("a", 0.3, 12.0), ("b", 0.0, 30.0), ("c", -0.3, 20.0), ("d", 0.05, 4.0), ("e", -0.1, 60.0)}
    rows = [(g, float(x)) for g, xi, scale in truth for x in drawn(rng, xi, scale, 6000)]
    over = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in likelihood.gpd_likelihood(over, ["g"]).collect()}
    exact = {r.g: r for r in fit_gpd(over, "g").collect()}
    for g, xi, scale in truth:
        assert got[g].n == 6000 and abs(got[g].xi - xi) < 0.05 and abs(got[g].scale / scale - 1) < 0.05
        assert abs(got[g].xi - exact[g].xi) < 2e-3 and abs(got[g].scale / exact[g].scale - 1) < 3e-3


def cost(x, xi, scale):
    return np.log(scale) + (1 + 1 / xi) * np.mean(np.log1p(xi * x / scale))


def test_small_groups_are_near_the_best_of_a_fine_grid(spark):
    rng = np.random.default_rng(2)
    groups = {g: drawn(rng, rng.uniform(-0.4, 0.5), rng.uniform(3, 60), int(rng.integers(8, 60))) for g in range(25)}
    over = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "g int, x double")
    for r in likelihood.gpd_likelihood(over, ["g"]).where("xi > -0.8").collect():
        x = groups[r.g]
        best = np.inf
        for t in np.concatenate([-np.geomspace(0.9999 / x.max(), 1e-5, 3000), np.geomspace(1e-5, 0.59, 3000)]):
            z = np.log1p(t * x).mean()
            if z >= -1:
                best = min(best, np.log(z / t) + z + 1)
        assert cost(x, r.xi, r.scale) - best < 1e-3


def test_awkward_groups(spark):
    rows = [("one", 5.0), ("equal", 7.0), ("equal", 7.0), ("equal", 7.0), ("null", None), ("tiny", 1e-9), ("huge", 1e6), ("huge", 3.0), (None, 4.0), (None, 8.0)]
    out = {r.g: r for r in likelihood.gpd_likelihood(spark.createDataFrame(rows, "g string, x double"), ["g"]).collect()}
    assert set(out) == {"one", "equal", "tiny", "huge", None} and out["equal"].mean == 7.0
    assert all(np.isfinite(out[g].xi) and out[g].scale > 0 for g in ("one", "equal", "tiny", "huge", None))
    assert likelihood.gpd_likelihood(spark.createDataFrame([], "g string, x double"), ["g"]).collect() == []


def test_pooled_tails(spark):
    """Over two tiles: each cell's tail is that of the excesses within the radius, compared with a fit of those alone."""
    from pyspark.sql import functions as F

    from cellweave.functions import grid

    rng = np.random.default_rng(3)
    cells = {(int(r), int(c)): drawn(rng, 0.2, 15.0, int(rng.integers(0, 9))).tolist() for r, c in {(r, c) for r, c in rng.integers(0, 14, (120, 2))}}
    cells[0, 13] = None
    frame = spark.createDataFrame([(r, c, x) for (r, c), x in cells.items()], "cell_row int, cell_col int, excesses array<double>")
    out = {(r.cell_row, r.cell_col): r for r in likelihood.pooled_tails(frame, 15.0, 3, *grid.cell_center(F.col("cell_row"), F.col("cell_col"))).collect()}
    assert set(out) == set(cells)
    place = {k: (np.radians(50.005 - (k[0] + 0.5) * 0.05), np.radians(-125.005 + (k[1] + 0.5) * 0.05)) for k in cells}
    pools = []
    for k in cells:
        near = lambda m, k=k: 2 * 6371 * np.arcsin(np.sqrt(np.sin((place[m][0] - place[k][0]) / 2) ** 2 + np.cos(place[k][0]) * np.cos(place[m][0]) * np.sin((place[m][1] - place[k][1]) / 2) ** 2)) <= 15
        pool = [x for m, xs in cells.items() if abs(m[0] - k[0]) <= 3 and abs(m[1] - k[1]) <= 3 and near(m) for x in xs or []]
        assert out[k].n_over == len(pool)
        pools += [(f"{k}", x) for x in pool]
    alone = {r.g: r for r in likelihood.gpd_likelihood(spark.createDataFrame(pools, "g string, x double"), ["g"]).collect()}
    for k, r in out.items():
        if r.n_over:
            assert (r.xi, r.scale) == pytest.approx((alone[f"{k}"].xi, alone[f"{k}"].scale), rel=1e-9)
        else:
            assert r.xi is None and r.scale is None


def test_pooled_parameters(spark):
    """Enough excesses give their tail within its bounds, few the default one; a light pool, or a small one, gives none."""
    sums = spark.createDataFrame([(0, c, 100.0, n, 3 * n, 9 * n, nz) for c, n, nz in ((0, 50.0, 60.0), (1, 50.0, 60.0), (2, 9.5, 60.0), (3, 12.0, 9.0), (4, 12.0, 12.0), (5, 12.0, 12.0))], "cell_row int, cell_col int, ny double, n double, s1 double, s2 double, n_nz double")
    tails = spark.createDataFrame([(0, 0, 40, 0.25, 15.0), (0, 1, 4, 0.25, 15.0), (0, 4, 0, None, None), (0, 5, 6, -0.9, 0.3)], "cell_row int, cell_col int, n_over long, xi double, scale double")
    out = {r.cell_col: r for r in likelihood.pooled_likelihood(sums, tails, 50.8).collect()}
    assert {c: (r.xi, r.scale) for c, r in out.items()} == {0: (0.25, 15.0), 1: (0.0, 12.7), 4: (0.0, 12.7), 5: (-0.5, 1.27)}
    assert out[4].sigma == pytest.approx(1e-3) and out[0].p_occ == 0.5


def test_tail_probability_reaches_its_cap(spark):
    from cellweave.operators.extremes import return_levels

    cell = [(0, 0, 0.9, 3.0, 0.4, 0.05, 5.0, 50.8)]
    frame = spark.createDataFrame(cell, "cell_row int, cell_col int, p_occ double, mu double, sigma double, xi double, scale double, u double")
    top = lambda **k: {r.rp: r.mm for r in return_levels(frame, (100, 10**7, 10**8), **k).collect()}
    assert top()[10**7] == top()[10**8] < 300 and top(cap=1 - 1e-9, most=508.0)[10**7] < top(cap=1 - 1e-9, most=508.0)[10**8]
