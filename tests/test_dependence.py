"""Random pairs, rank correlations and the copula against what they model."""

from math import erf, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import dependence, older


def test_drawn_pairs_are_spread_over_all_cells(spark):
    pairs = dependence.drawn_pairs(spark, 300).toPandas()
    assert pairs.pair.between(1, 5000).all() and pairs.pair.is_unique and (pairs.i != pairs.j).all() and 4950 < len(pairs) <= 5000
    for side in ("i", "j"):
        counts = np.bincount(pairs[side], minlength=301)[1:]
        assert pairs[side].between(1, 300).all() and ((counts - len(pairs) / 300) ** 2 / (len(pairs) / 300)).sum() < 400  # chi square of 299
    assert abs(np.corrcoef(pairs.i, pairs.j)[0, 1]) < 0.05
    assert pairs.equals(dependence.drawn_pairs(spark, 300).repartition(7).orderBy("pair").toPandas())
    assert dependence.drawn_pairs(spark, 0).count() == 0 and dependence.drawn_pairs(spark, 1).count() == 0


def test_cells_are_numbered(spark):
    cells = spark.createDataFrame([(r, c) for r in range(5) for c in range(4)] * 2, "cell_row int, cell_col int")
    assert [r.i for r in dependence.indexed(cells).orderBy("cell_row", "cell_col").collect()] == list(range(1, 21))
    some = dependence.indexed(cells, F.expr("-cell_col"), most=5).orderBy("i").collect()
    assert [(r.cell_row, r.cell_col) for r in some] == [(0, 3), (1, 3), (2, 3), (3, 3), (4, 3)]


def ranks(x):
    return np.array([((x < v).sum() + (x <= v).sum() - 1) / 2 for v in x])


def test_rank_matrix(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random((18, 6)) < 0.3, 0, np.round(rng.gamma(2, 10, (18, 6)), 0))
    rows = [(c + 1, 2000 + y, float(x[y, c])) for y in range(18) for c in range(6) if x[y, c] > 0]
    got = dependence.rank_matrix(spark.createDataFrame(rows, "i long, year int, mm double"), 6)
    assert np.allclose(got, np.corrcoef(np.array([ranks(x[:, c]) for c in range(6)])))


def test_fitted_length():
    rng = np.random.default_rng(2)
    km = dependence.planar_km(rng.uniform(30, 45, 60), rng.uniform(-110, -80, 60))
    noise = rng.normal(0, 0.02, km.shape)
    assert dependence.fitted_length(km, np.exp(-km / 240) + (noise + noise.T) / 2) == pytest.approx(240, rel=0.03)
    holes = np.where(rng.random(km.shape) < 0.2, np.nan, np.exp(-km / 90))
    assert dependence.fitted_length(km, holes) == pytest.approx(90, rel=1e-3)
    assert km[0, 0] == 0 and np.allclose(km, km.T)


def test_copula_peaks_have_the_models_moments(spark):
    """The largest of m normals: its mean and deviation, independent of the correlation; and normals' own correlation for m = 1."""
    rng = np.random.default_rng(3)
    km = dependence.planar_km(rng.uniform(35, 37, 12), rng.uniform(-99, -96, 12))
    factor = older.correlation_factor(km, 150.0)
    years = 4000
    one = dependence.copula_peaks(spark, factor, years, 1).toPandas().pivot(index="sim_year", columns="i", values="u")
    assert one.shape == (years, 12)
    assert (abs(one.mean() - 0.5) < 4 / sqrt(12 * years)).all()  # uniform, within four deviations
    model = np.exp(-km / 150)
    spearman = 6 / np.pi * np.arcsin(model / 2)
    assert np.abs(np.corrcoef(one.rank().T) - spearman).max() < 4 / sqrt(years)
    many = dependence.copula_peaks(spark, factor, years, 20).toPandas().pivot(index="sim_year", columns="i", values="u")
    assert (abs(many.mean() - 20 / 21) < 4 * sqrt(20 / 21**2 / 22 / years)).all()  # the largest of 20 uniforms
    again = dependence.copula_peaks(spark, factor, 40, 20, block=3).toPandas().sort_values(["sim_year", "i"]).u.to_numpy()
    assert np.allclose(again, many.iloc[:40].to_numpy().ravel(), rtol=0, atol=1e-12)


def test_quantiles_of_probabilities(spark):
    values = {1: [5.0, 20.0, 10.0], 2: [], 3: [float(x) for x in range(1, 10)]}
    asked = [(y, i, u) for i in values for y, u in enumerate([0.0, 0.3, 0.66, 0.67, 0.7, 0.75, 0.85, 0.95, 1.0])]
    got = dependence.quantiles_of(spark.createDataFrame(asked, "sim_year long, i long, u double"), spark.createDataFrame([(i, v) for i, x in values.items() for v in [*x, 0.0]], "i long, mm double"), 9).collect()
    assert len(got) == len(asked)
    for r in got:
        v = np.sort(values[r.i])
        column = np.concatenate([np.zeros(9 - len(v)), v])
        want = np.interp(r.u, np.arange(1, 10) / 10, column) if r.u > (9 - len(v)) / 9 else 0.0
        assert r.mm == pytest.approx(want if r.i != 3 or r.u > 0.1 else r.u * 10 * 1.0)


def test_aggregates_of_a_known_copula(spark):
    """Cells with exponential values: independent ones add their variances, tied ones their deviations."""
    values = [(i, float(-30 * np.log(1 - k / 400))) for i in (1, 2, 3, 4) for k in range(1, 400)]
    held = spark.createDataFrame(values, "i long, mm double")
    tied = np.zeros((4, 4))
    tied[:, 0] = 1
    out = {}
    for name, factor in (("alone", np.eye(4)), ("tied", tied)):
        found = dependence.quantiles_of(dependence.copula_peaks(spark, factor, 3000, 3), held, 399)
        out[name] = dependence.annual_aggregates(found, ["sim_year"], 50.0).toPandas()
    mean, var = 30 * (1 + 1 / 2 + 1 / 3), 900 * (1 + 1 / 4 + 1 / 9)  # of the largest of three
    for name, factor in (("alone", 4), ("tied", 16)):
        assert out[name]["aggregate"].mean() == pytest.approx(4 * mean, rel=0.03)
        assert out[name]["aggregate"].var() == pytest.approx(factor * var, rel=0.12)
        assert out[name].footprint.mean() == pytest.approx(4 * (1 - (1 - np.exp(-50 / 30)) ** 3), rel=0.06)
    assert set(out["tied"].footprint) <= {0, 4} and erf(0) == 0
