"""Queries that must cover all of their input, and those whose SQL states a smaller size."""

import os

import pytest

from cellweave.plans import registry
from tests.test_queries import SF, con, normal  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


def same(got, want):
    import pandas as pd

    pd.testing.assert_frame_equal(normal(got), normal(want), check_exact=False, atol=2e-6, rtol=1e-9)


def test_every_supplier_may_be_the_nearest_site(spark, con):  # noqa: F811
    import numpy as np

    from cellweave.functions import grid
    from cellweave.plans.artefacts import annuli
    from cellweave.sources.tables import COLS, ROWS, Tables

    s = np.sort(con.sql("select s_suppkey from supplier").fetchnumpy()["s_suppkey"])
    lat, lon = np.radians(25.0 + s * 7 % 24), np.radians(-120.0 + s * 13 % 50)
    want = {}
    for r in range(ROWS):
        for c in range(COLS):
            a, b = np.radians(49 - r * 1.25), np.radians(-120 + c * 2.0)
            h = np.sin((lat - a) / 2) ** 2 + np.cos(a) * np.cos(lat) * np.sin((lon - b) / 2) ** 2
            want[r, c] = s[np.round(2 * grid.EARTH_KM * np.arcsin(np.sqrt(h)), 6).argmin()]
    got = {(x.cell_row, x.cell_col): x.site_idx for x in annuli(Tables(spark, SF)).collect()}
    assert got == want and len(set(want.values())) > 1


def test_production_catalogue_is_many_times_the_largest_period():
    from cellweave.plans import checks, simulation

    assert simulation.SIM_YEARS == 50_000 and simulation.SIM_YEARS >= 100 * max(*simulation.PERIODS, *checks.RPS)


def test_counts_of_the_production_years(spark):
    rows = registry.QUERIES["sim_counts"](spark, SF).collect()
    assert len({r.sim_year for r in rows}) == len(rows) == 50_000


def test_levels_of_40_years_are_the_sql_ones_without_longer_periods(spark, con):  # noqa: F811
    from pyspark.sql import functions as F

    from cellweave.plans import simulation
    from cellweave.sources.tables import Tables

    t = Tables(spark, SF)
    annual = simulation.annual_max(t, 40).withColumn("mm", F.round("mm", 4))
    same(annual.toPandas(), con.sql(registry.SMALL_SQL["sim_annual_max"]).df())
    got = simulation.levels(t, 40).withColumn("mm", F.round("mm", 4)).toPandas()
    assert set(got.rp) == {2, 5, 10, 20, 40}
    same(got, con.sql(f"from ({registry.SMALL_SQL['empirical_rp']}) where rp <= 40").df())
    got = simulation.exceedance(t, 40).withColumn("peak", F.round("peak", 4)).select("rp", "peak", "peak_cells", "n_cells", "n_events").toPandas()
    same(got, con.sql(f"from ({registry.SMALL_SQL['pet_tables']}) where rp <= 40").df())


def test_other_queries_of_40_years_are_the_sql_ones(spark, con):  # noqa: F811
    from cellweave.plans import checks, simulation
    from cellweave.sources.tables import Tables

    t = Tables(spark, SF)
    catalog = simulation.history(t)[0]
    same(simulation.simulation.simulate(catalog, 40).withColumn("scale", simulation.F.round("scale", 6)).toPandas(), con.sql(registry.SMALL_SQL["sim_events"]).df())
    counts = registry.SMALL_SQL["sim_counts"]
    rate = catalog.agg(simulation.F.count(simulation.F.lit(1)) / simulation.F.count_distinct(simulation.F.year("start_date"))).scalar()
    same(simulation.simulation.yearly_counts(spark, rate, 40).toPandas(), con.sql(counts).df())
    same(simulation.map_occurrence_of(t, 40).toPandas(), con.sql(registry.SMALL_SQL["map_occurrence"]).df())
    same(simulation.map_levels_of(t, 40).toPandas(), con.sql(registry.SMALL_SQL["map_levels"]).df())
    rolled = simulation.rolled_footprints_of(t, 40).toPandas()
    same(rolled, con.sql(registry.SMALL_SQL["rolled_footprints"]).df())
    every = simulation.simulation.simulate(catalog, 40, 0.15, 0.0, 0.0, roll=2).toPandas()
    assert 0 < len(rolled) < len(every) and set(every.drow) == set(every.dcol) == {-2, -1, 0, 1, 2}
    assert "analytical_vs_stochastic" in registry.SMALL_SQL and checks.RPS


def test_counts_of_a_high_rate_are_not_cut(spark):
    from cellweave.operators.simulation import yearly_counts

    rate = spark.range(1).selectExpr("CAST(20000 AS DOUBLE) AS r").scalar()
    rows = [r.n for r in yearly_counts(spark, rate, 2000).collect()]
    assert len(rows) == 2000 and abs(sum(rows) / 2000 - 20000) < 20 and max(rows) > 20200 and 100 < (sum((n - 20000) ** 2 for n in rows) / 2000) ** 0.5 < 180


def test_one_event_can_be_simulated(spark):
    import datetime as dt

    from cellweave.operators import simulation

    one = spark.createDataFrame([(1, dt.date(2000, 5, 1), 40.0, 122)], "event_id long, start_date date, peak_hail_mm double, doy int")
    assert all(r.scale is not None for r in simulation.simulate(one, 30).collect())


def test_tail_dependence_takes_all_pairs(spark, con):  # noqa: F811
    import itertools

    import numpy as np

    cells = con.sql(registry.SQL["annual_max"]).df().query("1996 <= year <= 1998").groupby(["cell_row", "cell_col"]).mm.max().reset_index().query("mm >= 25.4")
    lat, lon = np.radians(49 - cells.cell_row.to_numpy() * 1.25), np.radians(-120 + cells.cell_col.to_numpy() * 2.0)
    want = dict.fromkeys((50, 150, 300), 0)
    for i, j in itertools.combinations(range(len(cells)), 2):
        h = np.sin((lat[i] - lat[j]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat[j]) * np.sin((lon[i] - lon[j]) / 2) ** 2
        km = round(2 * 6371.0 * np.arcsin(np.sqrt(h)), 6)
        for a, b in ((50, 150), (150, 300), (300, 600)):
            want[a] += a <= km < b
    got = {r.km_from: r.pairs for r in registry.QUERIES["tail_dependence"](spark, SF).collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_training_set_keeps_150_negatives_a_day(spark, tmp_path):
    """200 report-free event cells of one day and 3 of the next."""
    import datetime as dt

    day = dt.datetime(2000, 1, 1)
    cells = [(day, r, c) for r in range(20) for c in range(10)] + [(day + dt.timedelta(1), r, 0) for r in range(3)]
    spark.createDataFrame([(d, r, c, 1, "R", 100000.0) for d, r, c in cells], "l_shipdate timestamp_ntz, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(day, 1, 24, 100.0)], "o_orderdate timestamp_ntz, o_custkey long, o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    rows = registry.QUERIES["training_set"](spark, str(tmp_path)).collect()
    assert sorted(r.day.day for r in rows if r.hail == 0) == [1] * 150 + [2] * 3


@pytest.mark.parametrize("name", ["region_clusters", "gpd_likelihood_fit"])
def test_models_run(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0


def test_classifier_on_the_ten_features(spark):
    from cellweave.operators import models
    from cellweave.operators.correction import FEATURES
    from cellweave.plans.features import labelled_features
    from cellweave.sources.tables import Tables

    rows = labelled_features(Tables(spark, SF)).cache()
    got = {r.split: (r.n, r.auc) for r in models.classifier_report(rows, list(FEATURES), rounds=5).collect()}
    assert got["train"][0] + got["test"][0] == rows.count() and 0 <= got["test"][1] <= 1


def test_likelihood_fit_is_the_likeliest_of_a_grid(spark):
    import numpy as np

    from cellweave.operators.legacy import fit_gpd

    rng = np.random.default_rng(4)
    data = {r: (s / x) * ((1 - rng.random(n)) ** -x - 1) for r, (x, s, n) in enumerate(((0.2, 10.0, 400), (0.05, 30.0, 700), (-0.2, 5.0, 500)))}
    table = spark.createDataFrame([(r, float(v)) for r, xs in data.items() for v in xs], "region int, x double")

    def cost(x, xi, scale):
        z = 1 + xi * x / scale
        return np.inf if (z <= 0).any() else len(x) * np.log(scale) + (1 + 1 / xi) * np.log(z).sum()

    for r in fit_gpd(table, "region").collect():
        x = data[r.region]
        best = min(cost(x, xi, s) for xi in np.linspace(-0.5, 0.6, 112)[:-1] + 1e-4 for s in x.mean() * np.linspace(0.4, 1.6, 121))
        assert r.n == len(x) and cost(x, r.xi, r.scale) <= best + 1e-3
