"""Queries over the stochastic catalogue of 50,000 years; their SQL simulates 40, what another engine does in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.operators import climate, events, simulation
from cellweave.operators.simulation import normal, uniform
from cellweave.plans.climate import r6
from cellweave.plans.events import ACTIVE, AREA, CATALOG, GROUPS, STEPS, active, center, grouped
from cellweave.plans.registry import query
from cellweave.sources.shared import keep
from cellweave.sources.tables import CELL_DAY, COLS, ROWS

SIM_YEARS = 50_000
YEARS, PERIODS = 40, (2, 5, 10, 20, 40, 100)
BASE = (CELL_DAY, ACTIVE, STEPS, GROUPS, CATALOG)
SIGMA = "sig AS (SELECT coalesce(least(greatest(median(cv), 0.1), 0.4), 0.15) AS sigma FROM (SELECT month(start_date) AS m, count(*) AS n, stddev_pop(peak_hail_mm) / avg(peak_hail_mm) AS cv FROM cat WHERE peak_hail_mm > 0 GROUP BY 1) WHERE m BETWEEN 3 AND 9 AND n >= 10)"
DOY = """spread AS (SELECT (doy + d.range - 1 + 366) % 366 + 1 AS doy, n * exp(-(d.range * d.range) / 200e0) AS w FROM (SELECT doy, count(*) AS n FROM cat GROUP BY doy), range(-40, 41) d),
  share AS (SELECT d.range AS doy, coalesce(w, 0) / sum(w) OVER () AS p FROM range(1, 367) d LEFT JOIN (SELECT doy, sum(w) AS w FROM spread GROUP BY doy) s ON s.doy = d.range),
  dcdf AS (SELECT doy, p, sum(p) OVER (ORDER BY doy) AS cdf FROM share)"""
COUNTS = f"""rate AS (SELECT count(*) / count(DISTINCT year(start_date)) AS rate FROM cat),
  logf AS (SELECT range AS k, rate, sum(ln(greatest(range, 1))) OVER (ORDER BY range) AS lf FROM range(1000), rate),
  pois AS (SELECT k, sum(exp(k * ln(rate) - rate - lf)) OVER (ORDER BY k) AS cdf FROM logf),
  yrs AS (SELECT range AS sim_year, {uniform('range', '0', 0)} AS u FROM range(1, {YEARS + 1})),
  counts AS (SELECT sim_year, count(k) AS n FROM yrs LEFT JOIN pois ON cdf < u GROUP BY sim_year)"""
SIM = f"""evs AS (SELECT sim_year, unnest(range(1, n + 1)) AS event_idx FROM counts WHERE n > 0),
  dstep AS (SELECT doy AS draw_doy, coalesce(lag(cdf) OVER (ORDER BY doy), 0) AS clo, cdf AS chi FROM dcdf),
  drawn AS (SELECT sim_year, event_idx, draw_doy, {uniform('sim_year', 'event_idx', 2)} AS v FROM evs JOIN dstep ON {uniform('sim_year', 'event_idx', 1)} > clo AND {uniform('sim_year', 'event_idx', 1)} <= chi),
  tw AS (SELECT event_id AS template_id, d.range AS draw_doy, exp(-least(abs(doy - d.range), 366 - abs(doy - d.range)) / 30e0) AS w FROM cat, range(1, 367) d),
  thi AS (SELECT draw_doy, template_id, sum(w) OVER (PARTITION BY draw_doy ORDER BY template_id) / sum(w) OVER (PARTITION BY draw_doy) AS hi FROM tw),
  tt AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY draw_doy ORDER BY template_id), 0) AS lo FROM thi),
  pct AS (SELECT event_id AS template_id, (row_number() OVER (ORDER BY peak_hail_mm, event_id) - 1) / (count(*) OVER () - 1) AS pct FROM cat),
  sim AS (SELECT sim_year, event_idx, d.draw_doy, t.template_id, exp(least(greatest(pct * 0.15e0 + 0.10e0, 0.10e0), greatest(0.25e0, (SELECT sigma FROM sig))) * {normal('sim_year', 'event_idx', 3)}) AS scale,
    CAST(round_even({normal('sim_year', 'event_idx', 5)} * 3, 0) AS INTEGER) AS drow, CAST(round_even({normal('sim_year', 'event_idx', 7)} * 3, 0) AS INTEGER) AS dcol, {uniform('sim_year', 'event_idx', 9)} < 0.25 AS grown
    FROM drawn d JOIN tt t ON t.draw_doy = d.draw_doy AND v >= lo AND v < hi JOIN pct USING (template_id))"""
CELLS = f"""moves AS (SELECT * FROM (VALUES (0, 0, 1e0), (-1, 0, 0.5e0), (1, 0, 0.5e0), (0, -1, 0.5e0), (0, 1, 0.5e0)) AS x(mr, mc, f)),
  scells AS (SELECT sim_year, event_idx, r AS cell_row, c AS cell_col, max(mm) AS mm FROM (SELECT sim_year, event_idx, cell_row + drow + mr AS r, cell_col + dcol + mc AS c, least(mm * scale * f, 300) AS mm FROM sim JOIN ecells ON event_id = template_id JOIN moves ON grown OR f = 1)
    WHERE r BETWEEN 0 AND {ROWS - 1} AND c BETWEEN 0 AND {COLS - 1} AND (r, c) IN (SELECT (cell_row, cell_col) FROM ecells) GROUP BY ALL),
  sann AS (SELECT sim_year, cell_row, cell_col, max(mm) AS mm FROM scells GROUP BY ALL)"""


def history(t):
    """The catalogue and its cells, kept once."""
    days = keep(grouped(t), "event-days")
    cells = keep(events.event_cells(days, active(t)), "event-cells")
    return keep(events.event_catalog(days, cells, *center(), AREA), "catalog"), cells


def sim_cells(t, years=SIM_YEARS):
    catalog, cells = history(t)
    return simulation.simulated_cells(simulation.simulate(catalog, years), cells, ROWS, COLS)


def annual_max(t, years=SIM_YEARS):
    return sim_cells(t, years).groupBy("sim_year", *climate.CELL).agg(F.max("mm").alias("mm"))


def levels(t, years=SIM_YEARS, periods=PERIODS):
    """Empirical levels of the periods that the simulated years can show."""
    return simulation.empirical_levels(annual_max(t, years), years, tuple(p for p in periods if p <= years))


def exceedance(t, years=SIM_YEARS, periods=PERIODS):
    return simulation.exceedance_table(keep(simulation.yearly_extremes(sim_cells(t, years)), "sim-years"), years, tuple(p for p in periods if p <= years))


@query(*BASE, SIGMA, sql="SELECT round(sigma, 6) AS sigma FROM sig")
def sigma_calibration(t):
    return simulation.sigma(history(t)[0]).select(*r6("sigma"))


@query(*BASE, DOY, sql="SELECT doy, round(p, 8) AS p, round(cdf, 8) AS cdf FROM dcdf")
def doy_cdf(t):
    return simulation.doy_cdf(history(t)[0]).select("doy", F.round("p", 8).alias("p"), F.round("cdf", 8).alias("cdf"))


@query(*BASE, COUNTS, sql="SELECT sim_year, n FROM counts", small=True)
def sim_counts(t):
    catalog = history(t)[0]
    return simulation.yearly_counts(t.spark, catalog.agg(F.count(F.lit(1)) / F.count_distinct(F.year("start_date"))).scalar(), SIM_YEARS)


@query(*BASE, SIGMA, DOY, COUNTS, SIM, sql="SELECT sim_year, event_idx, draw_doy, template_id, round(scale, 6) AS scale, drow, dcol, grown FROM sim", small=True)
def sim_events(t):
    return simulation.simulate(history(t)[0], SIM_YEARS).withColumn("scale", F.round("scale", 6))


@query(*BASE, SIGMA, DOY, COUNTS, SIM, CELLS, sql="SELECT sim_year, cell_row, cell_col, round(mm, 4) AS mm FROM sann", small=True)
def sim_annual_max(t):
    return annual_max(t).withColumn("mm", F.round("mm", 4))


@query(*BASE, SIGMA, DOY, COUNTS, SIM, CELLS, "k AS (SELECT * FROM (VALUES " + ", ".join(f"({p}, {max(1, YEARS // p)})" for p in PERIODS) + ") AS x(rp, k))", "rk AS (SELECT cell_row, cell_col, mm, row_number() OVER (PARTITION BY cell_row, cell_col ORDER BY mm DESC) AS k FROM sann)", sql="SELECT rp, c.cell_row, c.cell_col, round(coalesce(mm, 0), 4) AS mm FROM (SELECT DISTINCT cell_row, cell_col FROM sann) c CROSS JOIN k LEFT JOIN rk ON rk.cell_row = c.cell_row AND rk.cell_col = c.cell_col AND rk.k = k.k", small=True)
def empirical_rp(t):
    return levels(t).withColumn("mm", F.round("mm", 4))


@query(*BASE, SIGMA, DOY, COUNTS, SIM, CELLS, "per AS (SELECT y.sim_year, coalesce(max(peak), 0) AS peak, coalesce(arg_max(n, (peak, -event_idx)), 0) AS peak_cells, coalesce(sum(n), 0) AS n_cells, count(event_idx) AS n_events FROM yrs y LEFT JOIN (SELECT sim_year, event_idx, max(mm) AS peak, count(*) FILTER (WHERE mm >= 25.4) AS n FROM scells GROUP BY ALL) e ON e.sim_year = y.sim_year GROUP BY y.sim_year)", "a AS (SELECT peak, row_number() OVER (ORDER BY peak DESC) AS k FROM per), e AS (SELECT peak_cells, row_number() OVER (ORDER BY peak_cells DESC) AS k FROM per), b AS (SELECT n_cells, row_number() OVER (ORDER BY n_cells DESC) AS k FROM per), c AS (SELECT n_events, row_number() OVER (ORDER BY n_events DESC) AS k FROM per)", sql="SELECT rp, round(peak, 4) AS peak, CAST(peak_cells AS BIGINT) AS peak_cells, CAST(n_cells AS BIGINT) AS n_cells, n_events FROM (VALUES " + ", ".join(f"({p}, {max(1, YEARS // p)})" for p in PERIODS) + ") AS x(rp, k) JOIN a USING (k) JOIN e USING (k) JOIN b USING (k) JOIN c USING (k)", small=True)
def pet_tables(t):
    return exceedance(t).select("rp", F.round("peak", 4).alias("peak"), "peak_cells", "n_cells", "n_events")


def map_simulation(t, years):
    """The second, older simulation for maps: templates stay in place, deviation 0.15."""
    catalog, cells = history(t)
    events_ = simulation.simulate(catalog, years, fixed_sigma=0.15, shift_cells=0.0, grow=0.0)
    return simulation.simulated_cells(events_, cells, ROWS, COLS).groupBy("sim_year", *climate.CELL).agg(F.max("mm").alias("mm"))


OLD = SIM.replace("exp(least(greatest(pct * 0.15e0 + 0.10e0, 0.10e0), greatest(0.25e0, (SELECT sigma FROM sig)))", "exp(0.15e0").replace("* 3, 0)", "* 0, 0)").replace(" < 0.25 AS grown", " < 0 AS grown")


@query(*BASE, SIGMA, DOY, COUNTS, OLD, CELLS, sql=f"SELECT t AS threshold_mm, cell_row, cell_col, round(count(*) FILTER (WHERE mm >= t) / {YEARS}, 6) AS p FROM sann, (SELECT unnest([25.4e0, 50.8e0, 101.6e0]) AS t) GROUP BY ALL", small=True)
def map_occurrence(t):
    """Share of simulated years at or over each threshold, by cell, in the second simulation."""
    return map_occurrence_of(t, SIM_YEARS)


def map_occurrence_of(t, years):
    rows = map_simulation(t, years).withColumn("threshold_mm", F.explode(F.array(*map(F.lit, (25.4, 50.8, 101.6)))))
    return rows.groupBy("threshold_mm", *climate.CELL).agg(F.round(F.count_if(F.col("mm") >= F.col("threshold_mm")) / years, 6).alias("p"))


@query(*BASE, SIGMA, DOY, COUNTS, OLD, CELLS, "k AS (SELECT * FROM (VALUES " + ", ".join(f"({p}, {max(1, YEARS // p) + 1})" for p in (5, 10, 20)) + ") AS x(rp, k))", "rk AS (SELECT cell_row, cell_col, mm, row_number() OVER (PARTITION BY cell_row, cell_col ORDER BY mm DESC) AS k FROM sann)", sql="SELECT rp, cell_row, cell_col, round(mm, 4) AS mm FROM rk JOIN k USING (k) WHERE mm >= 25.4", small=True)
def map_levels(t):
    """Levels of the second simulation by ranks from 0; under 25.4 mm no value."""
    return map_levels_of(t, SIM_YEARS)


def map_levels_of(t, years, periods=(5, 10, 20)):
    return simulation.empirical_levels(map_simulation(t, years), years, periods, extra=1).where("mm >= 25.4").withColumn("mm", F.round("mm", 4))


DAMAGE, ROLL = 25.4, 2
ROLLED = OLD.replace(f"CAST(round_even({normal('sim_year', 'event_idx', 5)} * 0, 0) AS INTEGER) AS drow", f"{simulation.rolled('sim_year', 'event_idx', 5, ROLL)} AS drow").replace(f"CAST(round_even({normal('sim_year', 'event_idx', 7)} * 0, 0) AS INTEGER) AS dcol", f"{simulation.rolled('sim_year', 'event_idx', 7, ROLL)} AS dcol")
ANYWHERE = CELLS.replace(" AND (r, c) IN (SELECT (cell_row, cell_col) FROM ecells)", "")


@query(*BASE, SIGMA, DOY, COUNTS, ROLLED, ANYWHERE, sql=f"SELECT sim_year, event_idx, count(*) AS n_cells, round(max(mm), 4) AS max_mm, round(avg(mm), 4) AS mean_mm, count(*) * {AREA}e0 AS footprint_km2 FROM scells WHERE mm >= {DAMAGE} GROUP BY ALL", small=True)
def rolled_footprints(t):
    """Footprints of the older catalogue's events, moved by up to two rows and columns; events without damage have none."""
    return rolled_footprints_of(t, SIM_YEARS)


def rolled_footprints_of(t, years):
    catalog, cells = history(t)
    moved = simulation.simulate(catalog, years, fixed_sigma=0.15, shift_cells=0.0, grow=0.0, roll=ROLL)
    found = simulation.footprints(simulation.simulated_cells(moved, cells, ROWS, COLS, known_only=False), DAMAGE, AREA)
    return found.select("sim_year", "event_idx", "n_cells", F.round("max_mm", 4).alias("max_mm"), F.round("mean_mm", 4).alias("mean_mm"), "footprint_km2")
