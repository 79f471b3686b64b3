import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import legacy, models, older


def test_broken_stick(spark):
    years = list(range(1980, 2021, 5))
    bends = {1990: 0.02, 2000: -0.05, 2010: 0.01, 2020: 0.0}
    true = lambda y: 7 + 0.03 * (y - 1980) + sum(b * max(0, y - k) for k, b in bends.items())
    rows = [("long", y, float(np.exp(true(y)))) for y in years] + [("two", 1990, 100.0), ("two", 2000, 400.0), ("two", 2001, 0.0), ("line", 1980, 10.0), ("line", 1990, 20.0), ("line", 2000, 40.0)]
    out = {}
    for r in older.broken_stick(spark.createDataFrame(rows, "name string, year int, population double"), "name").collect():
        out[r.name, r.year] = r.trend
    assert all(out["long", y] == pytest.approx(np.exp(true(y)), rel=1e-6) for y in range(1980, 2021))
    assert out["two", 1980] == pytest.approx(200.0) and out["line", 2010] == pytest.approx(80.0, rel=1e-6)


def test_decay_length_and_factor():
    km = np.arange(50.0, 2000, 100)
    assert older.decay_length(km, np.exp(-km / 180)) == pytest.approx(180, rel=1e-4)
    rng = np.random.default_rng(1)
    at = rng.random((30, 2)) * 800
    dist = np.sqrt(((at[:, None] - at) ** 2).sum(2))
    low = older.correlation_factor(dist, 150.0)
    model = np.exp(-dist / 150)
    assert np.allclose(low @ low.T, model, atol=1e-6) and np.allclose(np.triu(low, 1), 0)
    odd = np.array([[0.0, 1.0, 900.0], [1.0, 0.0, 1.0], [900.0, 1.0, 0.0]])  # no metric, so not positive definite
    low = older.correlation_factor(odd, 100.0)
    assert np.allclose(np.diag(low @ low.T), 1) and np.linalg.eigvalsh(low @ low.T).min() > 0


def test_composite_level_inverts_its_distribution(spark):
    from math import erf, exp, log, sqrt

    p, mu, sigma, xi, scale, u, rate = 0.6, 3.2, 0.5, 0.1, 12.0, 40.0, 0.9
    sql = older.composite_level("rp", *(f"CAST({v} AS DOUBLE)" for v in (p, mu, sigma, xi, scale, u, rate)))
    cdf = lambda x: (1 + erf((log(x) - mu) / sigma / sqrt(2))) / 2
    for r in spark.createDataFrame([(float(t),) for t in (1, 2, 5, 20, 100)], "rp double").selectExpr("rp", f"{sql} AS h").collect():
        if r.h == 0:
            assert r.rp * p <= 1
            continue
        f_u = cdf(u)
        f = cdf(r.h) if r.h <= u else f_u + (1 - f_u) * rate * (1 - (1 + xi * (r.h - u) / scale) ** (-1 / xi))
        assert 1 - p + p * f == pytest.approx(1 - 1 / r.rp, abs=2e-6) and exp(mu) > 0


def test_missing_month_is_an_error(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 4.0), ("a", 2, 6.0)], "chunk string, month int, t double")
    assert {r.month: r["mean"] for r in legacy.month_climatology(rows, "chunk", "month", "t", (1, 2)).collect()} == {1: 3.0, 2: 6.0}
    with pytest.raises(Exception, match="missing months: 3"):
        legacy.month_climatology(rows, "chunk", "month", "t", (1, 2, 3)).collect()


def test_classifier_knows_what_can_be_known(spark):
    """Labels that hang on a product of features are learnt, also for years it didn't see; labels by chance are not."""
    rng = np.random.default_rng(8)
    rows = [(dt.date(2010 + i % 8, 5, 1), *map(float, rng.normal(size=2)), float(rng.integers(0, 2))) for i in range(1600)]
    table = spark.createDataFrame(rows, "day date, a double, b double, chance double")
    auc = lambda label: {r.split: (r.n, r.auc) for r in models.classifier_report(table.withColumn("label", label), ["a", "b"], rounds=12).collect()}
    known, chance = auc((F.col("a") * F.col("b") > 0).cast("double")), auc(F.col("chance"))
    assert known["train"][0] == 1200 and known["test"][0] == 400
    assert known["test"][1] > 0.95 and 0.4 < chance["test"][1] < 0.6


def test_model_scores_and_the_fallback(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = spark.createDataFrame([(float(i), float(i % 7), float(i > 20)) for i in range(40)], "v double, lat double, label double")
    steps = Pipeline(stages=[VectorAssembler(inputCols=["v", "lat"], outputCol="features"), LogisticRegression(maxIter=20)])
    steps.fit(rows).write().overwrite().save(str(tmp_path / "model"))
    got = models.model_probabilities(rows, str(tmp_path / "model")).collect()
    assert all(0 <= r.p <= 1 for r in got) and np.mean([(r.p > 0.5) == (r.label == 1) for r in got]) > 0.9
    assert all(r.p is None for r in models.model_probabilities(rows, str(tmp_path / "none")).collect())
    assert all(r.p is None for r in models.model_probabilities(rows.drop("lat"), str(tmp_path / "model")).collect())


def test_chain_removes_what_each_pass_should(spark):
    """A spike, a ring and a filament on one gridded day; the other source's day only gets recalibrated."""
    from cellweave.operators import correction
    from cellweave.sources.shared import keep
    from cellweave.plans.fine import ROW0, COL0, SIDE

    near = [(ROW0 + r, COL0 + c) for r in range(SIDE) for c in range(SIDE)]
    annuli = spark.createDataFrame([(r, c, 0, float(((r - ROW0) ** 2 + (c - COL0) ** 2) ** 0.5 * 5), 40.0, -105.0, 38.0, -104.0, int(((r - ROW0) ** 2 + (c - COL0) ** 2) ** 0.5 * 5 // 10), 0, 0) for r, c in near], "cell_row int, cell_col int, site_idx long, km double, lat double, lon double, site_lat double, site_lon double, bin int, coarse int, sector int")
    day, other = dt.date(2013, 6, 1), dt.date(2013, 6, 2)
    rows = [(day, r, c, 6.0) for r, c in near if 5 <= r - ROW0 < 15 and 5 <= c - COL0 < 15] + [(day, ROW0 + 40, COL0 + 40, 90.0), (other, ROW0 + 9, COL0 + 9, 30.0), (other, ROW0, COL0, 2.0)]
    cells = spark.createDataFrame(rows, "day date, cell_row int, cell_col int, mm double")
    labels = spark.createDataFrame([(day,)], "day date")
    done, stats = correction.corrected(cells, labels, annuli.withColumn("flagged", F.lit(False)), 520, 1180, F.lit(40.0), keep)
    got = {r.day: r for r in stats.collect()}
    assert got[day].source == "GridRad" and got[day].in_pixels == 101 and got[day].artefacts_removed >= 1
    assert got[other].source == "MYRORSS/MRMS" and got[other].artefacts_removed == 0 and got[other].peak_in_mm == 30.0
    assert (dt.date(2013, 6, 1), ROW0 + 40, COL0 + 40) not in {(r.day, r.cell_row, r.cell_col) for r in done.collect()}
