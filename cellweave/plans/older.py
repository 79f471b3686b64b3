"""Queries over the first version's statistics and the remaining scalar rules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cellweave.functions import clock, grid
from cellweave.operators import climate, dependence, events, extremes, ingest, older, polygons, spatial
from cellweave.plans import simulation
from cellweave.plans.climate import r6
from cellweave.plans.events import LAT_SQL, LON_SQL, active, center, grouped
from cellweave.plans.events import ACTIVE, GROUPS, STEPS
from cellweave.plans.extremes import CHAIN, PERIODS, U, levels_sql, parameters
from cellweave.plans.ingest import PANEL, panel
from cellweave.plans.registry import query
from cellweave.sources import grids, listing, sinks
from cellweave.sources.shared import keep
from cellweave.sources.tables import CELL_DAY, COLS, OBS, REPORT, ROWS

COUNTIES = """counties AS (SELECT s_suppkey * 37 % 90000 AS geoid, CASE s_suppkey % 4 WHEN 0 THEN 'Saint ' ELSE '' END || 'Name ' || (s_suppkey % 23) || CASE s_suppkey % 3 WHEN 0 THEN ' County' WHEN 1 THEN ' city' ELSE '' END AS county_name, s_nationkey % 5 AS state FROM supplier),
  asked AS (SELECT c_custkey, 'NAME ' || (c_custkey % 31) || CASE c_custkey % 2 WHEN 0 THEN ' CO' ELSE ' parish' END AS county_name, c_nationkey % 5 AS state FROM customer)"""


def _clean(c: str) -> str:
    return f"trim(regexp_replace(trim(regexp_replace(regexp_replace(upper(trim({c})), '[^A-Z0-9]+', ' ', 'g'), '\\b(COUNTY|PARISH|BOROUGH|CITY)$', '')), '^SAINT ', 'ST '))"


@query(COUNTIES, f"best AS (SELECT county, state, arg_min(geoid, (CAST(geoid % 1000 >= 500 AS INTEGER), geoid)) AS geoid FROM (SELECT *, {_clean('county_name')} AS county FROM counties) GROUP BY ALL)", sql=f"SELECT c_custkey, geoid FROM (SELECT *, CASE WHEN {_clean('county_name')} LIKE 'NAME % CO' THEN regexp_replace({_clean('county_name')}, ' CO$', '') ELSE {_clean('county_name')} END AS county FROM asked) LEFT JOIN best USING (county, state)")
def county_fips(t):
    """Counties of reports by cleaned name, aliases and the rule for ambiguous names."""
    k, s = F.col("s_suppkey"), F.col("c_custkey")
    name = F.concat(F.when(k % 4 == 0, "Saint ").otherwise(""), F.lit("Name "), k % 23, F.when(k % 3 == 0, " County").when(k % 3 == 1, " city").otherwise(""))
    counties = t.read("supplier").select((k * 37 % 90000).alias("geoid"), name.alias("county_name"), (F.col("s_nationkey") % 5).alias("state"))
    asked = t.read("customer").select("c_custkey", F.concat(F.lit("NAME "), s % 31, F.when(s % 2 == 0, " CO").otherwise(" parish")).alias("county_name"), (F.col("c_nationkey") % 5).alias("state"))
    aliases = t.spark.range(31).select(F.concat(F.lit("NAME "), "id", F.lit(" CO")).alias("alias"), F.concat(F.lit("NAME "), "id").alias("county"))
    return older.match_counties(asked, older.county_lookup(counties), aliases).select("c_custkey", "geoid")


@query(PANEL, "usable AS (SELECT county, year, total, wind AS population, ln(wind) AS x, ln(total) AS y FROM panel WHERE total > 0 AND wind > 0)", "fits AS (SELECT county, regr_slope(y, x) AS beta, regr_intercept(y, x) AS a FROM usable GROUP BY county HAVING count(*) >= 5 AND regr_slope(y, x) IS NOT NULL)", "idx AS (SELECT *, total / exp(a + beta * x) AS i FROM usable JOIN fits USING (county))", sql="SELECT county, year, round(beta, 6) AS beta, round(i / coalesce(max(CASE WHEN year = 1998 THEN i END) OVER (PARTITION BY county), 1), 6) AS adjusted, round(total / population * 100000e0, 4) AS per_capita FROM idx")
def county_adjusted(t):
    """Counts adjusted by a log-log line on population, 1 in 1998, and per 100,000."""
    rows = panel(t).withColumn("population", F.col("wind"))
    return older.adjusted_counts(rows, "county", 1998).select("county", "year", *r6("beta", "adjusted"), F.round("per_capita", 4).alias("per_capita"))


@query(PANEL, sql="SELECT year FROM panel WHERE hail > 0 INTERSECT SELECT year FROM panel WHERE wind > 0")
def years_with_both(t):
    rows = panel(t)
    return rows.where("hail > 0").select("year").intersect(rows.where("wind > 0").select("year"))


@query(CELL_DAY, sql="SELECT strftime(day, '%m%d') AS mmdd, cell_row, cell_col, round(sum(mm), 6) AS total, count(*) AS n FROM cell_day GROUP BY ALL")
def mmdd_climatology(t):
    return t.cell_day().groupBy(F.date_format("day", "MMdd").alias("mmdd"), *climate.CELL).agg(F.round(F.sum("mm"), 6).alias("total"), F.count(F.lit(1)).alias("n"))


@query("span AS (SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS d FROM orders)", "had AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)", sql="SELECT strftime(s.d, '%m%d') AS mmdd, month(s.d) AS month, count(*) AS years, count(*) FILTER (WHERE year(s.d) % 4 = 0 AND (year(s.d) % 100 <> 0 OR year(s.d) % 400 = 0)) AS leap_years, CAST(coalesce(sum(n), 0) AS BIGINT) AS reports FROM span s LEFT JOIN had ON had.d = s.d GROUP BY ALL")
def calendar_days(t):
    """The 366 day labels of the reports' span: in how many years each occurs, in how many leap ones, and its reports."""
    day = F.to_date("o_orderdate")
    had = t.read("orders").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    ends = t.read("orders").agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
    d, leap = F.col("day"), (F.year("day") % 4 == 0) & ((F.year("day") % 100 != 0) | (F.year("day") % 400 == 0))
    days = listing.days_between(t.spark, ends.a, ends.b).join(had, "day", "left")
    return days.groupBy(F.date_format(d, "MMdd").alias("mmdd"), F.month(d).alias("month")).agg(F.count(F.lit(1)).alias("years"), F.count_if(leap).alias("leap_years"), F.coalesce(F.sum("n"), F.lit(0)).alias("reports"))


@query(sql="SELECT o_orderkey, CASE WHEN y < 80 THEN y + 2000 ELSE y + 1900 END AS year FROM (SELECT o_orderkey, o_custkey % 100 AS y FROM orders)")
def two_digit_years(t):
    return t.read("orders").select("o_orderkey", clock.two_digit_year(F.col("o_custkey") % 100).alias("year"))


@query(sql="SELECT o_orderkey, 'out/' || strftime(o_orderdate, '%Y') || '/mesh_' || strftime(o_orderdate, '%Y%m%d') || '.tif' AS path FROM orders")
def day_paths(t):
    return t.read("orders").select("o_orderkey", listing.day_path("out", F.col("o_orderdate"), ".tif").alias("path"))


@query(REPORT, "bins AS (SELECT *, least(CAST(floor(size_in * 100 / 25) AS INTEGER), 15) AS bin, (least(CAST(floor(size_in * 100 / 25) AS INTEGER), 15) * 25) || '-' || (least(CAST(floor(size_in * 100 / 25) AS INTEGER), 15) * 25 + 24) || ' hundredths_of_inches' AS tag FROM report)", sql="SELECT year(day) AS year, strftime(day, '%m%d') AS mmdd, bin, count(*) AS n, round((CAST(regexp_extract(tag, '(\\d+)-(\\d+)', 1) AS DOUBLE) + CAST(regexp_extract(tag, '(\\d+)-(\\d+)', 2) AS DOUBLE)) / 2 / 100, 6) AS mid_in FROM bins GROUP BY ALL")
def report_bins(t):
    """Reports by year, day label and size bin, with the bin's middle read from its tag."""
    bin_ = F.least(F.floor(F.col("size_in") * 100 / 25), F.lit(15)).cast("int")
    rows = t.report().withColumn("bin", bin_).withColumn("tag", F.concat(F.col("bin") * 25, F.lit("-"), F.col("bin") * 25 + 24, F.lit(" hundredths_of_inches")))
    end = lambda i: F.regexp_extract("tag", r"(\d+)-(\d+)", i).cast("double")
    return rows.groupBy(F.year("day").alias("year"), F.date_format("day", "MMdd").alias("mmdd"), "bin", F.round((end(1) + end(2)) / 2 / 100, 6).alias("mid_in")).agg(F.count(F.lit(1)).alias("n"))


@query(sql="SELECT id, TRY_CAST(w[1] AS BIGINT) AS geoid, lpad(w[2], 5, '0') AS code, TRY_CAST(w[3] AS BIGINT) AS population FROM (SELECT c_custkey AS id, regexp_split_to_array(trim('  ' || c_custkey || '   ' || c_nationkey || '  ' || CASE c_custkey % 7 WHEN 0 THEN 'n/a' ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END || ' '), '\\s+') AS w FROM customer)")
def block_lines(t):
    """White-space-delimited lines of a block file, bad numbers null."""
    k = F.col("c_custkey")
    line = F.concat(F.lit("  "), k, F.lit("   "), "c_nationkey", F.lit("  "), F.when(k % 7 == 0, "n/a").otherwise(F.floor("c_acctbal").cast("string")), F.lit(" "))
    return ingest.split_lines(t.read("customer").select(k.alias("id"), line.alias("line")), ("geoid", "code", "population")).select("id", F.col("geoid").try_cast("long").alias("geoid"), F.lpad("code", 5, "0").alias("code"), F.col("population").try_cast("long").alias("population"))


_LEVEL = older.composite_level("rp", "p_occ", "mu", "sigma", "xi", "scale", "u", "rate")
RATES = f"rated AS (SELECT p.*, coalesce(n_exc, 0) / n AS rate FROM parameters p JOIN body USING (cell_row, cell_col) LEFT JOIN tail USING (cell_row, cell_col))"


@query(*CHAIN, RATES.replace("p.*, coalesce", "p.*, coalesce"), sql=f"SELECT rp, cell_row, cell_col, round({_LEVEL}, 4) AS mm FROM (SELECT *, unnest([10, 50, 100, 500]) AS rp FROM rated)")
def composite_levels(t):
    """Levels of the first version's composite distribution, with its exceedance-rate factor."""
    annual = climate.annual_max(t.cell_day()).where("mm > 0")
    rates = annual.groupBy(*climate.CELL).agg((F.count_if(F.col("mm") > U) / F.count(F.lit(1))).alias("rate"), F.count(F.lit(1)).alias("_n"))
    rates = rates.select(*climate.CELL, F.when(F.col("_n") >= 5, F.col("rate")).otherwise(0.0).alias("rate"))
    rows = parameters(t).join(rates, climate.CELL).withColumn("rp", F.explode(F.array(*map(F.lit, (10, 50, 100, 500)))))
    return rows.select("rp", *climate.CELL, F.round(F.expr(_LEVEL), 4).alias("mm"))


CENTROIDS = "cents AS (SELECT n_name AS name, 25e0 + n_nationkey * 7 % 24 AS clat, -120e0 + n_nationkey * 13 % 48 AS clon FROM nation)"


def cell_counties(t):
    """The coarse grid's cells with the nearest of the nations' stand-in centroids."""
    cells = t.spark.range(ROWS * COLS).select(F.floor(F.col("id") / COLS).cast("int").alias("cell_row"), (F.col("id") % COLS).cast("int").alias("cell_col"))
    cents = t.read("nation").select(F.col("n_name").alias("name"), (F.lit(25.0) + F.col("n_nationkey") * 7 % 24).alias("lat"), (F.lit(-120.0) + F.col("n_nationkey") * 13 % 48).alias("lon"))
    return older.nearest_centroid(cells, cents, F.lit(49.0) - F.col("cell_row") * 1.25, F.lit(-120.0) + F.col("cell_col") * 2.0)


NEAREST = f"{CENTROIDS}, near AS (SELECT cell_row, cell_col, arg_min(name, (d, name)) AS name FROM (SELECT cell_row, cell_col, name, pow(49e0 - cell_row * 1.25e0 - clat, 2) + pow(-120e0 + cell_col * 2e0 - clon, 2) AS d FROM (SELECT CAST(range // {COLS} AS INTEGER) AS cell_row, CAST(range % {COLS} AS INTEGER) AS cell_col FROM range({ROWS * COLS})), cents) GROUP BY ALL)"


@query(NEAREST, sql="SELECT cell_row, cell_col, name FROM near")
def nearest_county(t):
    return cell_counties(t)


BETAS = "betas AS (SELECT county AS name, CASE WHEN count(*) >= 5 AND regr_slope(ln(total), ln(year - 1990)) IS NOT NULL THEN least(greatest(regr_slope(ln(total), ln(year - 1990)), -5), 5) ELSE 1 END AS beta FROM panel GROUP BY county)"


@query(CELL_DAY, PANEL, NEAREST, BETAS, "refs AS (SELECT county AS name, total AS ref FROM panel WHERE year = 1998)", sql="SELECT day, cell_row, cell_col, round(mm * coalesce(CASE WHEN total > 0 THEN pow(ref * 1e0 / total, beta) ELSE 1 END, 1), 6) AS mm FROM cell_day JOIN near USING (cell_row, cell_col) LEFT JOIN (SELECT county AS name, year, total, ref, beta FROM panel JOIN refs ON refs.name = county JOIN betas ON betas.name = county) p ON p.name = near.name AND p.year = year(day)")
def population_debias(t):
    """Daily maxima times (population of 1998 / the year's) ** beta of the cell's county."""
    rows = keep(panel(t), "panel")
    slope = F.regr_slope(F.ln("total"), F.ln(F.col("year") - 1990))
    betas = rows.groupBy(F.col("county").alias("name")).agg(F.when((F.count(F.lit(1)) >= 5) & slope.isNotNull(), F.least(F.greatest(slope, F.lit(-5.0)), F.lit(5.0))).otherwise(1.0).alias("beta"))
    population = rows.select(F.col("county").alias("name"), "year", F.col("total").alias("population"))
    cells = t.cell_day().withColumn("year", F.year("day")).join(cell_counties(t), climate.CELL)
    return older.population_debias(cells, population, betas, 1998).select("day", *climate.CELL, *r6("mm"))


@query(PANEL)
def population_trend(t):
    """Broken-stick trends of each county's counts over 1980 to 2023."""
    return older.broken_stick(panel(t).select("county", "year", F.col("total").alias("population")), "county")


SMOOTH = f"""occ AS (SELECT cell_row, cell_col, t AS threshold_mm, count(*) FILTER (WHERE mm >= t) * 1e0 AS n FROM ecells, (SELECT unnest([6.35e0, 12.7e0, 25.4e0, 38.1e0, 50.8e0, 76.2e0, 101.6e0, 127e0]) AS t) GROUP BY ALL),
  opairs AS (SELECT a.cell_row, a.cell_col, b.threshold_mm, b.n, round({grid.haversine_sql(*(x.replace('cell_', p + '.cell_') for p in ('a', 'b') for x in (LAT_SQL, LON_SQL)))}, 6) AS km FROM (SELECT DISTINCT cell_row, cell_col FROM occ) a JOIN occ b ON abs(a.cell_row - b.cell_row) <= 29 AND abs(a.cell_col - b.cell_col) <= 29)"""


@query(CELL_DAY, ACTIVE, STEPS, GROUPS, SMOOTH, sql="SELECT threshold_mm, cell_row, cell_col, round(CASE WHEN count(*) >= 5 THEN sum(exp(-km / 75e0) * n) / sum(exp(-km / 75e0)) ELSE max(CASE WHEN km = 0 THEN n END) END, 6) AS events FROM opairs WHERE km <= 150 GROUP BY ALL")
def smooth_occurrence(t):
    """Events at or over each of eight thresholds by cell, smoothed over 150 km; a cell with under five partners keeps its own."""
    cells = events.event_cells(grouped(t), active(t))
    marks = F.array(*map(F.lit, (6.35, 12.7, 25.4, 38.1, 50.8, 76.2, 101.6, 127.0)))
    counts = keep(cells.groupBy(*climate.CELL).agg(*(F.count_if(F.col("mm") >= m).cast("double").alias(f"t{i}") for i, m in enumerate((6.35, 12.7, 25.4, 38.1, 50.8, 76.2, 101.6, 127.0)))), "counts")
    sums = spatial.pooled(counts, 150.0, 75.0, 29, *center(), [f"t{i}" for i in range(8)])
    rows = sums.join(counts.select(*climate.CELL, F.array(*(F.col(f"t{i}") for i in range(8))).alias("own")), climate.CELL)
    smooth = F.array(*(F.when(F.col("partners") >= 5, F.col(f"t{i}") / F.col("weight")).otherwise(F.col("own")[i]) for i in range(8)))
    return rows.select(*climate.CELL, F.posexplode(smooth).alias("i", "events")).select(marks[F.col("i")].alias("threshold_mm"), *climate.CELL, F.round("events", 6).alias("events"))


KM = grid.haversine_sql('(49e0 - a.cell_row * 1.25e0)', '(-120e0 + a.cell_col * 2e0)', '(49e0 - b.cell_row * 1.25e0)', '(-120e0 + b.cell_col * 2e0)')
DRAWS = 5000
INDEXED = "picked AS MATERIALIZED (SELECT cell_row, cell_col, row_number() OVER (ORDER BY cell_row, cell_col) AS i FROM (SELECT DISTINCT cell_row, cell_col FROM ecells))"
PAIRED = f"""drawn AS MATERIALIZED (SELECT range AS pair, {dependence.draw_sql('range', 1, 'n')} AS i, {dependence.draw_sql('range', 2, 'n')} AS j FROM range(1, {DRAWS + 1}), (SELECT count(*) AS n FROM picked)),
  cp AS (SELECT pair, a.i, b.i AS j, round({KM}, 6) AS km FROM drawn JOIN picked a ON a.i = drawn.i JOIN picked b ON b.i = drawn.j WHERE drawn.i <> drawn.j),
  ev_i AS (SELECT i, event_id, mm FROM ecells JOIN picked USING (cell_row, cell_col)),
  xy AS (SELECT pair, event_id, max(x) AS x, max(y) AS y FROM (SELECT pair, event_id, mm AS x, 0e0 AS y FROM cp JOIN ev_i USING (i) UNION ALL SELECT pair, event_id, 0e0, mm FROM cp JOIN ev_i ON ev_i.i = cp.j) GROUP BY ALL),
  rk2 AS (SELECT pair, rank() OVER (PARTITION BY pair ORDER BY x) + (count(*) OVER (PARTITION BY pair, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY pair ORDER BY y) + (count(*) OVER (PARTITION BY pair, y) - 1) / 2 AS ry FROM xy),
  rhos AS (SELECT pair, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM rk2 GROUP BY pair HAVING count(*) >= 5)"""


def drawn_pairs(t):
    """Event values of all cells by number, and 5,000 random pairs of cells with distances."""
    cells = keep(events.event_cells(grouped(t), active(t)), "event-cells")
    numbered = keep(dependence.indexed(cells), "cell-numbers")
    lat, lon = F.lit(49.0) - F.col("cell_row") * 1.25, F.lit(-120.0) + F.col("cell_col") * 2.0
    one, two = numbered.select("i", lat.alias("a1"), lon.alias("o1")), numbered.select(F.col("i").alias("j"), lat.alias("a2"), lon.alias("o2"))
    pairs = dependence.drawn_pairs(t.spark, numbered.count(), DRAWS).join(one, "i").join(two, "j")
    pairs = keep(pairs.select("pair", "i", "j", F.round(grid.haversine_km(F.col("a1"), F.col("o1"), F.col("a2"), F.col("o2")), 6).alias("km")), "pairs")
    return cells.join(numbered, climate.CELL).select("event_id", "i", "mm"), pairs


def decay_bins(t):
    values, pairs = drawn_pairs(t)
    return older.binned_correlation(older.pair_correlations(values, pairs).join(pairs.select("pair", "km"), "pair"))


@query(CELL_DAY, ACTIVE, STEPS, GROUPS, INDEXED, PAIRED, sql="SELECT (floor(km / 100) + 0.5) * 100 AS km_mid, count(*) AS n, round(avg(rho), 6) AS mean, round(quantile_cont(rho, 0.25), 6) AS p25, round(quantile_cont(rho, 0.75), 6) AS p75 FROM rhos JOIN cp USING (pair) WHERE rho IS NOT NULL AND km < 2000 GROUP BY 1 HAVING count(*) >= 3")
def pair_decay(t):
    """Rank correlation of 5,000 random pairs of cells by distance."""
    return decay_bins(t).select("km_mid", "n", *r6("mean", "p25", "p75"))


@query()
def decay_length(t):
    """One row: the distance over which the random pairs' correlations fall to 1/e, fitted to the distance bins."""
    rows = decay_bins(t).orderBy("km_mid").collect()  # a row a distance bin
    length = older.decay_length(np.array([r.km_mid for r in rows]), np.array([r["mean"] for r in rows])) if rows else 30.0
    return t.spark.createDataFrame([(len(rows), round(length, 6))], "bins int, length_km double")


def copula_cells(t):
    """At most 800 cells by number, their distances, and the values of the catalogue's events in them."""
    catalog, cells = simulation.history(t)
    order = F.expr("(cell_row * 7919 + cell_col * 104729) % 10007")
    numbered = keep(dependence.indexed(cells, order, most=dependence.MOST_CELLS), "cell-numbers")
    at = np.array([(49.0 - r.cell_row * 1.25, -120.0 + r.cell_col * 2.0) for r in numbered.orderBy("i").collect()]).reshape(-1, 2)  # 800 rows at most
    return catalog, numbered, dependence.planar_km(at[:, 0], at[:, 1]), cells.join(numbered, climate.CELL).select("event_id", "i", "mm")


@query()
def spearman_decay(t):
    """One row: the decay length fitted to the rank correlations of all pairs of at most 800 cells' annual maxima."""
    _, numbered, km, _ = copula_cells(t)
    annual = climate.annual_max(t.cell_day()).join(numbered, climate.CELL).select("i", "year", "mm")
    n = len(km)
    length = dependence.fitted_length(km, dependence.rank_matrix(annual, n)) if n > 1 else None
    return t.spark.createDataFrame([(n, n * (n - 1) // 2, length and round(length, 4))], "cells int, pairs int, length_km double")


#: Years that the copula simulates, and its decay lengths.
COPULA_YEARS, LENGTHS = 2000, (100, 150, 200)


@query()
def copula_aggregates(t):
    """Annual aggregates of a Gaussian copula over the cells, 2,000 years for each of three decay lengths, with as many events a
    year as the catalogue has."""
    catalog, _, km, values = copula_cells(t)
    size = catalog.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.year("start_date")).alias("years")).first()
    out = None
    for length in LENGTHS:
        one = dependence.copula_peaks(t.spark, older.correlation_factor(km, length), COPULA_YEARS if len(km) else 0, max(1, round(size.n / max(size.years, 1)))).withColumn("length_km", F.lit(length))
        out = one if out is None else out.unionByName(one)
    found = dependence.quantiles_of(out, keep(values, "cell-values"), max(size.n, 1))
    return dependence.annual_aggregates(found, ["length_km", "sim_year"]).select("length_km", "sim_year", F.round("aggregate", 6).alias("aggregate"), "footprint")


CITIES = (("Dallas", 32.78, -96.80), ("Denver", 39.74, -104.99), ("Oklahoma City", 35.47, -97.52), ("Kansas City", 39.10, -94.58), ("Omaha", 41.26, -95.94), ("San Antonio", 29.42, -98.49))
_CITY_CELLS = tuple((c, min(max(round((49 - la) / 1.25), 0), ROWS - 1), min(max(round((lo + 120) / 2), 0), COLS - 1)) for c, la, lo in CITIES)


@query(*CHAIN, levels_sql(PERIODS), "towns AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {r}, {k})" for c, r, k in _CITY_CELLS) + ") AS x(city, cell_row, cell_col))", sql="SELECT city, rp, round(1e0 / rp, 8) AS probability, round(mm, 4) AS mm FROM levels JOIN towns USING (cell_row, cell_col) WHERE mm > 0")
def city_curves(t):
    """Levels against annual probability at the cells of a few cities."""
    towns = t.spark.createDataFrame(_CITY_CELLS, "city string, cell_row int, cell_col int")
    out = older.city_curves(extremes.return_levels(parameters(t), PERIODS), towns)
    return out.select("city", "rp", F.round("probability", 8).alias("probability"), F.round("mm", 4).alias("mm"))


# A coarse outline of the contiguous land area, as a stand-in for the boundary file.
OUTLINE = ((48.5, -124.5), (40.5, -124.5), (34.5, -120.5), (32.5, -117.0), (31.5, -110.5), (29.0, -103.0), (26.0, -97.5), (29.5, -94.0), (29.0, -89.5), (30.0, -84.5), (25.5, -81.0), (31.0, -81.0), (35.5, -75.5), (41.0, -72.0), (44.5, -67.5), (47.5, -69.5), (45.0, -75.0), (42.0, -82.5), (46.5, -84.5), (48.5, -95.0))
_INSIDE = older.inside_polygon_sql("lat", "lon", OUTLINE)


def corners(t, outlines):
    rows = [(name, r, i, float(a), float(b)) for name, rings in outlines.items() for r, ring in enumerate(rings) for i, (a, b) in enumerate(ring)]
    return t.spark.createDataFrame(rows, "polygon string, ring int, seq int, lat double, lon double")


@query(CELL_DAY, sql=f"SELECT cell_row, cell_col, {_INSIDE} AS land FROM (SELECT DISTINCT cell_row, cell_col, 49e0 - cell_row * 1.25e0 AS lat, -120e0 + cell_col * 2e0 AS lon FROM cell_day)")
def polygon_mask(t):
    """Which cells with daily maxima have their centre inside an outline."""
    cells = t.cell_day().select(*climate.CELL, (F.lit(49.0) - F.col("cell_row") * 1.25).alias("lat"), (F.lit(-120.0) + F.col("cell_col") * 2.0).alias("lon")).distinct()
    return polygons.mask_of(cells, corners(t, {"land": (OUTLINE,)})).select(*climate.CELL, "land")


#: Outlines for points: the land with a lake in it, a concave plain across its border, and two parts of a coast.
OUTLINES = {
    "land": (OUTLINE, ((45.9, -87.5), (41.7, -87.4), (41.6, -86.8), (45.8, -85.1))),
    "plain": (((37.0, -104.0), (49.0, -104.0), (43.2, -100.6), (49.0, -96.5), (36.5, -94.6), (33.5, -98.9), (29.4, -98.5), (34.0, -103.5)),),
    "coast": (((25.1, -82.0), (31.0, -83.2), (31.0, -79.9), (25.1, -79.9)), ((29.0, -98.0), (29.0, -88.9), (30.9, -88.0), (31.2, -97.2))),
}
_EDGES_SQL = ", ".join(f"('{name}', {min(p, q)[0]!r}e0, {min(p, q)[1]!r}e0, {max(p, q)[0]!r}e0, {max(p, q)[1]!r}e0)" for name, rings in OUTLINES.items() for ring in rings for p, q in zip(ring, ring[1:] + ring[:1], strict=True) if p[0] != q[0])


@query(f"edges(polygon, lo, lo_lon, hi, hi_lon) AS (VALUES {_EDGES_SQL})", "spots AS (SELECT event_id, 24e0 + event_id * 37 % 2600 / 100e0 AS lat, -125e0 + (user_id * 53 + event_id * 11) % 5900 / 100e0 AS lon FROM events)", sql="SELECT event_id, polygon FROM spots JOIN edges ON lat >= lo AND lat < hi AND lon < lo_lon + (lat - lo) * (hi_lon - lo_lon) / (hi - lo) GROUP BY event_id, polygon HAVING count(*) % 2 = 1")
def points_in_outlines(t):
    """The outlines, concave, in parts and with a hole, that the places of events lie in."""
    spots = t.read("events").select("event_id", (F.lit(24.0) + F.col("event_id") * 37 % 2600 / 100.0).alias("lat"), (F.lit(-125.0) + (F.col("user_id") * 53 + F.col("event_id") * 11) % 5900 / 100.0).alias("lon"))
    return polygons.polygons_of(spots, corners(t, OUTLINES)).select("event_id", "polygon")


@query(sql="SELECT CAST(trunc((50.005e0 - lat) / 0.05e0) AS INTEGER) AS cell_row, CAST(trunc((lon + 125.005e0) / 0.05e0) AS INTEGER) AS cell_col, round(avg(CASE WHEN e < 0 THEN 0 ELSE e END), 6) AS elevation_m FROM (SELECT 24.5e0 + l_partkey * 31 % 2500 / 100e0 AS lat, -124.5e0 + l_suppkey * 17 % 5000 / 100e0 AS lon, l_quantity * 50 - 200 AS e FROM lineitem) GROUP BY ALL")
def elevation_grid(t):
    """Elevation points averaged over the grid's cells."""
    points = t.read("lineitem").select((F.lit(24.5) + F.col("l_partkey") * 31 % 2500 / 100.0).alias("lat"), (F.lit(-124.5) + F.col("l_suppkey") * 17 % 5000 / 100.0).alias("lon"), (F.col("l_quantity") * 50 - 200).cast("double").alias("elevation_m"))
    return grids.resample_elevation(points).withColumn("elevation_m", F.round("elevation_m", 6))


@query(CELL_DAY, OBS, "found AS (SELECT day, count(*) AS active, round(max(mm), 1) AS max_mm FROM cell_day GROUP BY day)", "listed AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS files FROM orders GROUP BY 1)", sql="SELECT coalesce(f.day, l.day) AS day, coalesce(files, 0) AS files, coalesce(active, 0) AS active, coalesce(max_mm, 0) AS max_mm, CASE WHEN coalesce(files, 0) = 0 THEN 'missing_source' WHEN coalesce(active, 0) = 0 THEN 'no_hail_pixels' ELSE 'ok' END AS status FROM found f FULL JOIN listed l ON f.day = l.day")
def manifest_rebuild(t):
    """A manifest made anew from the outputs and the listing of sources."""
    listed = t.read("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("files"))
    return ingest.rebuild_manifest(t.cell_day(), listed)


@query(OBS, "cov AS (SELECT CAST(ts - INTERVAL 12 HOUR AS DATE) AS day, count(DISTINCT hour(ts)) >= 6 AS covered FROM obs WHERE source = 'B' GROUP BY 1)", sql="SELECT d.day, CASE WHEN covered THEN 'fine' WHEN covered IS NOT NULL THEN 'fine+gap_fill' ELSE 'coarse' END AS choice FROM (SELECT DISTINCT CAST(ts - INTERVAL 12 HOUR AS DATE) AS day FROM obs) d LEFT JOIN cov USING (day)")
def adaptive_source(t):
    """Fine source where it covers the day, with gap-fill where it has something, else the coarse one."""
    day = clock.convective_day(F.col("ts"))
    coverage = t.obs().where("source = 'B'").groupBy(day.alias("day")).agg((F.count_distinct(F.hour("ts")) >= 6).alias("covered"))
    return listing.choose_source(coverage, t.obs().select(day.alias("day")))


@query(CELL_DAY, "tags AS (SELECT day, CASE WHEN day(day) <= 10 THEN max(mm) + 1 END AS max_mm FROM cell_day GROUP BY day)", sql="SELECT day, round(coalesce(t.max_mm, max(c.mm), 0), 6) AS peak_mm FROM cell_day c FULL JOIN tags t USING (day) GROUP BY day, t.max_mm")
def metadata_peaks(t):
    """Daily peaks from stored tags where there are any, else from the cells."""
    top = F.max("mm") + 1
    tags = t.cell_day().groupBy("day").agg(F.when(F.dayofmonth("day") <= 10, top).alias("max_mm"))
    return sinks.peaks(t.cell_day(), tags).select("day", *r6("peak_mm"))


@query(*simulation.BASE, sql="SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS position, count(*) AS n_cells, round(sum(mm), 6) AS total, any_value(n_active_cells) = count(*) AS aligned FROM cat JOIN ecells USING (event_id) GROUP BY event_id")
def aligned_events(t):
    """The catalogue beside its cells, in the same order."""
    from pyspark.sql import Window

    catalog, cells = simulation.history(t)
    rows = catalog.select("event_id", "n_active_cells").join(cells.select("event_id", "mm"), "event_id").groupBy("event_id").agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.sum("mm"), 6).alias("total"), F.first("n_active_cells").alias("_n"))
    return rows.select("event_id", (F.row_number().over(Window.orderBy("event_id")) - 1).alias("position"), "n_cells", "total", (F.col("_n") == F.col("n_cells")).alias("aligned"))


@query(*simulation.BASE, sql="SELECT 'events' AS metric, count(*) * 1e0 AS v FROM cat UNION ALL SELECT 'events_a_year', round(count(*) / count(DISTINCT year(start_date)), 6) FROM cat UNION ALL SELECT 'peak_mm', round(max(peak_hail_mm), 6) FROM cat UNION ALL SELECT 'active_cells', (SELECT count(DISTINCT (cell_row, cell_col)) FROM ecells) * 1e0 UNION ALL SELECT 'days', (SELECT count(DISTINCT day) FROM cell_day) * 1e0")
def publication_metrics(t):
    """Headline numbers, a row each."""
    catalog, cells = simulation.history(t)
    one = lambda name, df, value: df.agg(value.cast("double").alias("v")).select(F.lit(name).alias("metric"), "v")
    n = F.count(F.lit(1))
    out = one("events", catalog, n)
    for part in (one("events_a_year", catalog, F.round(n / F.count_distinct(F.year("start_date")), 6)), one("peak_mm", catalog, F.round(F.max("peak_hail_mm"), 6)), one("active_cells", cells, F.count_distinct(*climate.CELL)), one("days", t.cell_day(), F.count_distinct("day"))):
        out = out.unionByName(part)
    return out
