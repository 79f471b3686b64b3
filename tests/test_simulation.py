"""Cells of simulated events are made where the events are, once each."""

import datetime as dt
import itertools
import re

import pytest

from cellweave.operators import simulation

SHAPES = {1: {(2, 2): 40.0, (2, 3): 90.0, (3, 2): 10.0}, 2: {(0, 0): 250.0, (5, 5): 30.0}}


@pytest.fixture
def cells(spark):
    return spark.createDataFrame([(e, r, c, v) for e, x in SHAPES.items() for (r, c), v in x.items()], "event_id long, cell_row int, cell_col int, mm double")


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame([(1, dt.date(2000, 5, 1), 90.0, 122), (2, dt.date(2001, 6, 1), 250.0, 152)], "event_id long, start_date date, peak_hail_mm double, doy int")


EVENTS = [(1 + i, 1, t, s, dr, dc, g) for i, (t, s, (dr, dc), g) in enumerate(itertools.product(SHAPES, (0.7, 1.9), ((0, 0), (1, -1), (-3, 3)), (True, False)))]


@pytest.mark.parametrize("known", [True, False])
@pytest.mark.parametrize("shaped", [simulation.SHAPED, 0])
def test_cells_are_the_greatest_of_what_lies_on_them(spark, cells, known, shaped, monkeypatch):
    monkeypatch.setattr(simulation, "SHAPED", shaped)
    events = spark.createDataFrame(EVENTS, "sim_year long, event_idx long, template_id long, scale double, drow int, dcol int, grown boolean")
    got = [(r.sim_year, r.event_idx, r.cell_row, r.cell_col, r.mm) for r in simulation.simulated_cells(events, cells, 6, 6, known).collect()]
    ever, want = {at for x in SHAPES.values() for at in x}, {}
    for year, event, t, scale, dr, dc, grown in EVENTS:
        for ((r, c), v), (mr, mc, f) in itertools.product(SHAPES[t].items(), ((0, 0, 1.0), (-1, 0, 0.5), (1, 0, 0.5), (0, -1, 0.5), (0, 1, 0.5)) if grown else ((0, 0, 1.0),)):
            at = (r + dr + mr, c + dc + mc)
            if 0 <= at[0] < 6 and 0 <= at[1] < 6 and (at in ever or not known):
                want[year, event, *at] = max(want.get((year, event, *at), 0.0), min(v * scale * f, 300.0))
    assert sorted(got) == sorted((*k, v) for k, v in want.items())


def test_cells_of_a_year_are_not_exchanged(catalog, cells):
    """Neither events nor years nor cells of a year are dealt anew after the cells are made."""
    made = simulation.simulated_cells(simulation.simulate(catalog, 1500), cells, 6, 6)
    for out in (made.groupBy("sim_year", "cell_row", "cell_col").agg({"mm": "max"}), simulation.footprints(made, 25.4, 1.0), simulation.yearly_extremes(made)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("Generate posexplode")]
        assert "Exchange" not in above.replace("BroadcastExchange", "") and not re.search(r"hashpartitioning\([^)]*(event_idx|cell_row)", above)


def test_levels_read_the_annual_maxima_once(spark):
    annual = spark.range(40).selectExpr("id % 20 as sim_year", "cast(id div 20 as int) as cell_row", "0 as cell_col", "cast(id as double) as mm")
    out = simulation.empirical_levels(annual, 20, (2, 20))
    assert out._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    assert {(r.rp, r.cell_row): r.mm for r in out.collect()} == {(2, 0): 10.0, (2, 1): 30.0, (20, 0): 19.0, (20, 1): 39.0}
